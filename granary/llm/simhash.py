"""SimHash near-duplicates by a binary trie self-join.

1. Fingerprints: one pass over the texts leaves a narrow checkpointed table.
2. Equal fingerprints form a class; copies are never expanded into pairs.
3. Trie self-join over the classes. Of budget + c blocks of bits, two
   fingerprints within the error budget agree on c. For each choice of c
   blocks the trie starts with those bits, where no error is allowed, so its
   sub-tries are independent and are dealt out by those bits. c follows the
   number of classes, so that sub-tries stay small; it changes the work and
   never the links. Inside them
   pairs of nodes are traversed together, level by level: the children of a
   pair that differ in the bit add one error, and a pair over the budget is
   pruned. A pair of nodes that is connected already is pruned as well, so a
   dense group yields a spanning forest and not all its pairs.
4. Links between classes are joined to components; see components.py.

A sub-trie with many entries is split by the same argument over its own free
bits: two fingerprints in it that are within the budget agree on c of
budget + c blocks of those. So it becomes finer sub-tries, again and again
until they are small: those over HOT_ROWS entries, found by exact counts, by
Spark, those over TRAVERSED entries inside their task.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a text of any length is hashed whole, by one task; a null id links
too but names no component unless all ids in it are null; repeated rows share
a component; an empty table gives an empty result; other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import KEY_NAMES, checkpointed, keep_rows, row_key, table
from granary.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
BUDGET = 4
#: Entries that one traversal takes at a time, and pairs of nodes that it expands at a time.
CHUNK_ROWS = 100_000
FRONTIER = 1 << 16
#: Pairs of entries up to which a pair of nodes is compared entry by entry.
DIRECT = 16
#: Entries above which a sub-trie is split, by Spark and within a task.
HOT_ROWS = 200_000
TRAVERSED = 2048
#: Cells in which entries are counted first, and hot sub-tries that may be broadcast.
CELLS = 1 << 17
MAX_BROADCAST = 100_000
#: Free bits up to which a sub-trie isn't split further; it has at most 2 ** FREE_BITS fingerprints.
FREE_BITS = 16
#: Classes that a sub-trie holds on average at most.
SUB_TRIE = 64


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a UTF-8 text. A-Z are lower-cased; bytes.split() splits at the six whitespace characters."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __key_text of row_key() and fp of each row, checkpointed."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__key_text"), fps], names=["doc_id", "__key_text", "fp"])

    text, ident = docs[text_col], docs[id_col]
    rows = docs.select(ident.cast("long").alias("doc_id"), row_key(text, ident)[-1], text.cast("binary").alias("text"))
    return checkpointed(rows.mapInArrow(hashed, "doc_id long, __key_text long, fp long"))


def clean_blocks(n_classes: int, budget: int) -> int:
    """How many blocks the tries start with: the fewest that leave about SUB_TRIE classes in a sub-trie."""
    return next((c for c in (2, 3) if n_classes <= SUB_TRIE * 2 ** (64 * c / (budget + c))), 4)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


@cache
def finer_masks(mask: int, budget: int, clean: int = 2) -> list[int]:
    """``mask`` (signed) with each choice of ``clean`` out of budget + clean blocks of its free bits: at most ``budget`` errors leave so many blocks clean."""
    free = [p for p in range(64) if not mask >> p & 1]
    n = budget + clean
    edges = [round(len(free) * i / n) for i in range(n + 1)]
    blocks = [sum(1 << p for p in free[edges[i] : edges[i + 1]]) for i in range(n)]
    return [signed((mask % (1 << 64)) | sum(c)) for c in combinations(blocks, clean)]


def block_masks(budget: int, clean: int = 2) -> list[int]:
    """The masks with which the tries start."""
    return finer_masks(0, budget, clean)


class Forest:
    """Components of members 0 to n - 1; the root of each is its smallest member."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def unite(self, a, b) -> None:
        import numpy as np

        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def stars(self):
        """(member, root) of all members that aren't roots."""
        import numpy as np

        members = np.flatnonzero(self.root != np.arange(len(self.root)))
        return members, self.root[members]


def _compare(al, ah, bl, bh, near, member, forest: Forest) -> None:
    """Unites the near members of each pair of ranges, comparing entry by entry."""
    import numpy as np

    width = bh - bl
    ends = np.cumsum((ah - al) * width)
    for i in range(0, len(al), FRONTIER // DIRECT):
        own = slice(i, i + FRONTIER // DIRECT)
        first = ends[i - 1] if i else 0
        counts = np.diff(ends[own], prepend=first)
        k = np.arange(ends[own][-1] - first) - np.repeat(ends[own] - counts - first, counts)
        wide = np.repeat(width[own], counts)
        a, b = np.repeat(al[own], counts) + k // wide, np.repeat(bl[own], counts) + k % wide
        ahead = a < b
        a, b = a[ahead], b[ahead]
        ok = near(a, b)
        forest.unite(member[a[ok]], member[b[ok]])


def join_tries(bucket, words: Sequence, member, forest: Forest, budget: int, direct: int = DIRECT) -> None:
    """Unites the members whose fingerprints in one bucket differ in ``budget`` bits or fewer.

    bucket: ascending numbers; words: uint64 arrays, which make up the
    fingerprints, first bits first; entries ascend by bucket and fingerprint.
    Pairs of nodes with ``direct`` pairs of entries or fewer are leaves.
    """
    import numpy as np

    n = len(bucket)

    def near(a, b):
        return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words) <= budget

    for lag in (1, 2, 3):  # neighbours in order first: dense groups are then connected before the traversal
        a = np.flatnonzero(bucket[:-lag] == bucket[lag:]) if n > lag else np.empty(0, np.int64)
        a = a[near(a, a + lag)]
        forest.unite(member[a], member[a + lag])

    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.empty(0, np.int64)
    stops = np.r_[starts[1:], n] if n else starts
    many = stops - starts > 1
    lo, hi = starts[many], stops[many]
    stack = [(64 * len(words) - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int16))]
    while stack:
        bit, al, ah, bl, bh, errors = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, al[half:], ah[half:], bl[half:], bh[half:], errors[half:]), (bit, al[:half], ah[:half], bl[:half], bh[:half], errors[:half])]
            continue
        leaf = (ah - al) * (bh - bl) <= direct
        if leaf.any():
            _compare(*(x[leaf] for x in (al, ah, bl, bh)), near, member, forest)
        root = forest.root[member]
        changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
        known = (root[al] == root[bl]) & (changes[al] == changes[ah - 1]) & (changes[bl] == changes[bh - 1])
        todo = ~(leaf | known)
        if bit < 0 or not todo.any():
            continue
        al, ah, bl, bh, errors = (x[todo] for x in (al, ah, bl, bh, errors))
        word = words[len(words) - 1 - bit // 64]
        ones = np.r_[0, np.cumsum((word >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        other = al != bl
        parts = [
            (al, am, bl, bm, errors),
            (am, ah, bm, bh, errors),
            (al, am, bm, bh, errors + 1),
            tuple(x[other] for x in (am, ah, bl, bm, errors + 1)),
        ]
        al, ah, bl, bh, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (ah > al) & (bh > bl) & (errors <= budget) & ~((al == bl) & (ah - al == 1))
        if live.any():
            stack.append((bit - 1, *(x[live] for x in (al, ah, bl, bh, errors))))


def trie_links(masks, fps, budget: int = BUDGET):
    """Links (a, b) of fingerprints that connect those which agree on their mask's bits and differ in ``budget`` bits or fewer. masks, fps: int64, one of each for an entry."""
    import numpy as np

    values, member = np.unique(fps, return_inverse=True)
    bits = values.view(np.uint64)
    forest = Forest(len(values))

    def joined(masks, member, split: bool) -> list[tuple[int, object]]:
        """Joins the sub-tries; returns mask and members of those that are to be split."""
        own = bits[member]
        key = own & masks.view(np.uint64)
        order = np.lexsort((own, key, masks))
        masks, member, own, key = masks[order], member[order], own[order], key[order]
        bucket = np.r_[0, np.cumsum((masks[1:] != masks[:-1]) | (key[1:] != key[:-1]))]
        if not split or len(member) <= TRAVERSED or (size := np.bincount(bucket)).max() <= TRAVERSED:
            join_tries(bucket, [own], member, forest, budget)
            return []
        large = np.flatnonzero(size > TRAVERSED)
        small = size[bucket] <= TRAVERSED
        join_tries(bucket[small], [own[small]], member[small], forest, budget)
        edges = np.r_[0, np.cumsum(size)]
        return [(int(masks[edges[i]]), member[edges[i] : edges[i + 1]]) for i in large]

    todo = joined(masks, member, True) if len(fps) else []
    while todo:
        mask, own = todo.pop()
        a = np.flatnonzero(np.bitwise_count(bits[own[1:]] ^ bits[own[:-1]]) <= budget)
        forest.unite(own[a], own[a + 1])
        finer = finer_masks(mask, budget) if 64 - (mask % (1 << 64)).bit_count() > FREE_BITS else [mask]
        for m in finer:
            if (forest.root[own] != forest.root[own[0]]).any():
                todo += joined(np.full(len(own), m, np.int64), own, len(finer) > 1)
    member, root = forest.stars()
    return values[member], values[root]


def by_bucket(solve, n_keys: int, names: Sequence[str]):
    """For mapInArrow over rows of longs, sorted by their first ``n_keys`` columns: applies ``solve`` to arrays of about CHUNK_ROWS rows with whole buckets, or to one larger bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def solved(held):
            rows = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(rows)], names=list(names))

        held: list = []
        n = 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if n >= CHUNK_ROWS:
                same = (rows[:, :n_keys] == held[-1][-1, :n_keys]).all(axis=1)
                cut = len(rows) if same.all() else int(np.argmin(same))
                if cut:
                    held.append(rows[:cut])
                if cut < len(rows):
                    yield solved(held)
                    held, n, rows = [], 0, rows[cut:]
                else:
                    continue
            if len(rows):
                held.append(rows)
                n += len(rows)
        if held:
            yield solved(held)

    return run


def hot_keys(entries: DataFrame, names: Sequence[str], n_entries: int) -> DataFrame | None:
    """Keys with more than HOT_ROWS of the ``n_entries`` entries, checkpointed, or None. Counted exactly: first by cells, whose number is fixed, then in full cells by key."""
    if n_entries <= HOT_ROWS:
        return None
    cell = F.pmod(F.xxhash64(*names), F.lit(CELLS)).alias("__cell")
    cells = checkpointed(entries.select(cell).groupBy("__cell").count().where(F.col("count") > HOT_ROWS).select("__cell"))
    if cells.isEmpty():
        return None
    sizes = entries.select(*names, cell).join(F.broadcast(cells), "__cell").groupBy(*names).count()
    found = checkpointed(sizes.where(F.col("count") > HOT_ROWS).select(*names))
    return None if found.isEmpty() else found


def small(rows: DataFrame) -> DataFrame:
    """Broadcast only below a checked number of rows; else Spark chooses the join."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def class_links(classes: DataFrame, budget: int = BUDGET, clean: int = 2) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` at ``budget`` or fewer differing bits."""
    masks = block_masks(budget, clean)
    key = F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    entries = classes.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("mask", key, "fp")

    def refined(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            mask, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "fp"))
            parts = [(np.full(len(own), m, np.int64), own & m, own) for k in np.unique(mask) for own in [fps[mask == k]] for m in finer_masks(int(k), budget)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["mask", "key", "fp"])

    n_entries = len(masks) * classes.count()
    while (hot := hot_keys(entries.where(F.bit_count("mask") < 64 - FREE_BITS), ["mask", "key"], n_entries)) is not None:
        tagged = entries.join(small(hot.withColumn("hot", F.lit(True))), ["mask", "key"], "left")
        entries = checkpointed(tagged.where("hot is null").select("mask", "key", "fp").unionByName(tagged.where("hot").select("mask", "key", "fp").mapInArrow(refined, "mask long, key long, fp long")))
        n_entries = entries.count()
    dealt = entries.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def solve(rows):
        import numpy as np

        return trie_links(np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 2]), budget)

    return dealt.mapInArrow(by_bucket(solve, 2, "ab"), "a long, b long")


def first_row() -> Column:
    """The row that stands for its group: the smallest id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "__key_text")


def with_first(classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Adds the first row of its component, ``best``, to each class (``key``, first, n)."""
    members = checkpointed(classes.join(connected_components(links).withColumnRenamed("node", key), key, "left").select(key, "first", "n", F.coalesce("root", key).alias("root")))
    # Checkpointed, so that the join's sides are plain shuffles and AQE can split a large component's.
    best = checkpointed(members.groupBy("root").agg(F.min("first").alias("best")))
    return members.join(best, "root").select(key, "first", "n", "best")


def classified(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fp, first, n (rows) and best for each distinct fp of fingerprints()."""
    classes = checkpointed(rows.groupBy("fp").agg(F.min(first_row()).alias("first"), F.count(F.lit(1)).alias("n")))
    return with_first(classes, class_links(classes.select("fp"), budget, clean_blocks(classes.count(), budget)), "fp")


def decided(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """row_key() and __kept of each row: the first of each component stays; where rows alike in id and text are the first, their key stands there as dropped too."""
    best = F.struct(F.coalesce("best.doc_id", F.lit(0)), F.col("best.is_null"), F.col("best.__key_text"))
    names = [F.coalesce("doc_id", F.lit(0)).alias("__key_id"), F.col("doc_id").isNull().alias("__key_null"), "__key_text"]
    joined = rows.select(key, *names).join(found.select(key, "best", "n"), key)
    settled = checkpointed(joined.select(*KEY_NAMES, (F.struct(*KEY_NAMES) == best).alias("__kept"), (F.col("n") > 1).alias("__shared")))
    alike = settled.where("__kept and __shared").groupBy(*KEY_NAMES).count().where("count > 1").select(*KEY_NAMES, F.lit(False).alias("__kept"))
    return settled.select(*KEY_NAMES, "__kept").unionByName(alike)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id."""
    rows = fingerprints(docs, id_col, text_col)
    found = rows.join(classified(rows, budget), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The document with the smallest id of each component, with all columns."""
    rows = fingerprints(docs, id_col, text_col)
    return keep_rows(docs, decided(rows, classified(rows, budget), "fp"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: XXH64 isn't in DuckDB; tests compare with brute force.
ORACLE = None
