"""The pipeline's near-dedup: SimHash and the trie self-join of simhash.py, set for a similarity of 0.8.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of
SIMILARITY or more, checked exactly. Such a pair differs in 9.7 of 64 bits on
average, far beyond the budget that blocks of a 64-bit fingerprint can carry,
so the fingerprint has WORDS * 64 bits, and the tries start with seeded choices
of its bits instead of blocks:

1. One pass over the texts leaves a hash of each shingle set (equal sets form a
   class) and its SimHash.
2. Each of several tries starts with PREFIX_BITS or more bits, chosen by a
   seed. Two classes that agree on them meet in a sub-trie of the first BITS
   bits, where node pairs are traversed together and pruned beyond BUDGET
   errors. There are as many tries as a pair at exactly SIMILARITY needs to be
   found with a probability of RECALL. The prefix follows the number of
   classes, so that sub-tries stay small, and the number of tries follows the
   prefix; RECALL stays.
3. The links' components are candidate groups. In each group the shingle sets
   themselves are compared, all with all, by blocks of BLOCK_BYTES; a group of
   one block is one piece of work, a larger one a piece for each two blocks.
   Only links that connect are given back, never a group's pairs.
4. The verified links' components are the groups of which one document stays.

Shingle sets are made and shuffled for classes in candidate groups alone. A
sub-trie of more than HOT_ROWS entries is taken for one candidate group as it
stands, by an aggregation, which can only add comparisons.

Defined results: texts without words are alike; a text of fewer words than a
shingle is one shingle; A-Z are lower-cased; a text of any length is compared
whole; the smallest id of each component stays (null ids last), and of rows
alike in id and text one; an empty table gives an empty result; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import simhash
from granary.llm.common import KEY_NAMES, checkpointed, hash_filter, keep_rows, row_key, with_hit
from granary.llm.components import connected_components
from granary.llm.simhash import Forest, by_bucket, decided, first_row, hot_keys, join_tries, small, with_first

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
WORDS = 8
#: The share of bits in which a pair at SIMILARITY differs: the angle whose cosine is 2 * 0.8 / 1.8, by pi.
ERROR_SHARE = 0.1514
#: Of the first BITS bits a pair at SIMILARITY differs in 19.4 on average with a deviation of 4.1, so that 0.5 % are beyond BUDGET.
BITS, BUDGET = 128, 30
RECALL = 0.98
PREFIX_BITS, MAX_PREFIX = 12, 32
#: Classes that a sub-trie holds on average at most.
SUB_TRIE = 64
#: Leaves of the traversal: a budget this wide prunes pairs of larger nodes only.
DIRECT = 1024
BLOCK_BYTES = 1 << 20


def shingle_set(text: bytes | None, shingle_words: int = SHINGLE_WORDS):
    """Distinct 128-bit hashes of a UTF-8 text's shingles as two uint64 columns, ascending by the first."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle_words, len(words))
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def wide_fingerprint(hashes) -> list[int]:
    """The SimHash of a shingle set as WORDS signed longs; words after the first two are made of both halves of each hash."""
    import numpy as np

    ones = np.zeros(64 * WORDS, np.int64)
    odd = np.arange(1, 2 * WORDS - 4, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), 1024):
        part = hashes[i : i + 1024]
        more = (part[:, :1] + odd) * (part[:, 1:] | np.uint64(1))
        more ^= more >> np.uint64(32)
        more *= np.uint64(0xBF58476D1CE4E5B9)
        more ^= more >> np.uint64(29)
        ones += np.unpackbits(np.concatenate([part, more], axis=1).view(np.uint8).reshape(-1, 8 * WORDS), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view("<i8").tolist()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __key_text of row_key(), node (hash of the shingle set) and words (its SimHash) of each row, checkpointed."""

    def signed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            nodes, words = [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py())
                nodes.append(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))
                words.append(wide_fingerprint(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__key_text"), pa.array(nodes, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "__key_text", "node", "words"])

    text, ident = docs[text_col], docs[id_col]
    rows = docs.select(ident.cast("long").alias("doc_id"), row_key(text, ident)[-1], text.cast("binary").alias("text"))
    return checkpointed(rows.mapInArrow(signed, "doc_id long, __key_text long, node long, words array<long>"))


def prefix_bits(n_classes: int) -> int:
    return min(MAX_PREFIX, max(PREFIX_BITS, ceil(log2(max(1, n_classes) / SUB_TRIE))))


def n_tries(prefix: int) -> int:
    """Tries of which one holds a pair at SIMILARITY with a probability of RECALL, with the loss by BUDGET."""
    within = sum(comb(BITS, d) * ERROR_SHARE**d * (1 - ERROR_SHARE) ** (BITS - d) for d in range(BUDGET + 1))
    return ceil(log(1 - RECALL / within) / log(1 - (1 - ERROR_SHARE) ** prefix))


def prefix_masks(prefix: int) -> list[tuple[int, int]]:
    """(word, signed mask) of the bits with which each trie starts. Choices don't overlap before all words are used up."""
    import numpy as np

    rng, found = np.random.default_rng(SEED), []
    while len(found) < n_tries(prefix):
        order = [rng.permutation(64) for _ in range(WORDS)]
        found += [(w, simhash.signed(sum(1 << int(p) for p in order[w][at : at + prefix]))) for at in range(0, 65 - prefix, prefix) for w in range(WORDS)]
    return found[: n_tries(prefix)]


def _joined(rows):
    """Links of the nodes in each bucket: rows of key, high, low, node."""
    import numpy as np

    nodes, member = np.unique(rows[:, 3], return_inverse=True)
    high, low = (np.ascontiguousarray(rows[:, i]).view(np.uint64) for i in (1, 2))
    order = np.lexsort((low, high, rows[:, 0]))
    keys = rows[order, 0]
    forest = Forest(len(nodes))
    join_tries(np.r_[0, np.cumsum(keys[1:] != keys[:-1])], [high[order], low[order]], member[order], forest, BUDGET, DIRECT)
    member, root = forest.stars()
    return nodes[member], nodes[root]


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes (node, words) which meet in a trie within BUDGET."""
    n = classes.count()
    masks = prefix_masks(prefix_bits(n))
    keys = F.array(*[F.xxhash64(F.lit(i), F.get("words", F.lit(w)).bitwiseAND(F.lit(m))) for i, (w, m) in enumerate(masks)])
    entries = classes.select(F.explode(keys).alias("key"), *[F.get("words", F.lit(i)).alias(c) for i, c in enumerate(("high", "low"))], "node")
    hot = hot_keys(entries, ["key"], n * len(masks))
    stars = None
    if hot is not None:
        tagged = entries.join(small(hot.withColumn("hot", F.lit(True))), "key", "left")
        held = tagged.where("hot").select("key", "node")
        stars = held.join(held.groupBy("key").agg(F.min("node").alias("least")), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
        entries = tagged.where("hot is null").select("key", "high", "low", "node")
    links = entries.repartition("key").sortWithinPartitions("key").mapInArrow(by_bucket(_joined, 1, "ab"), "a long, b long")
    return links if stars is None else links.unionByName(stars)


def similar_links(sets: list):
    """Stars (member, root) that connect the sets (uint64 arrays) at SIMILARITY or more; two sets without members are alike."""
    import numpy as np

    forest = Forest(len(sets))
    sizes = np.array([len(x) for x in sets])
    none = np.flatnonzero(sizes == 0)
    forest.unite(none[1:], none[:-1])
    full = np.flatnonzero(sizes)
    if len(full) > 1:
        values, codes = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
        sizes = sizes[full]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        seen = np.zeros(len(values), bool)
        for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            if (forest.root[full] == forest.root[full[0]]).all():
                break
            own = codes[start : start + size]
            seen[own] = True
            both = np.add.reduceat(seen[codes], starts, dtype=np.int64)
            seen[own] = False
            near = np.flatnonzero(both >= SIMILARITY * (sizes + size - both))
            forest.unite(full[near], np.full(len(near), full[i]))
    return forest.stars()


def _verified(batches: Iterator) -> Iterator:
    """Links of the similar nodes in each piece of work: rows of root, x, y, node, hashes, sorted by the first three."""
    import numpy as np
    import pyarrow as pa

    def solve(held):
        member, root = similar_links([np.frombuffer(x, "<u8") for _, x in held])
        return [(held[m][0], held[r][0]) for m, r in zip(member.tolist(), root.tolist(), strict=True)]

    def batch_of(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    at, held = None, []
    for batch in batches:
        links = []
        for root, x, y, node, hashes in zip(*[batch.column(c).to_pylist() for c in ("root", "x", "y", "node", "hashes")], strict=True):
            if (root, x, y) != at:
                links += solve(held) if len(held) > 1 else []
                at, held = (root, x, y), []
            held.append((node, hashes))
        yield batch_of(links)
    yield batch_of(solve(held) if len(held) > 1 else [])


def _set_of(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [shingle_set(t.as_py())[:, 0].tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY_NAMES], pa.array(found, pa.binary())], names=[*KEY_NAMES, "hashes"])


def member_sets(docs: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """root, node and hashes of each class in ``groups`` (node, root), checkpointed. Rows that a filter of fixed size rules out aren't shuffled."""
    keys = [F.coalesce("first.doc_id", F.lit(0)).alias("__key_id"), F.col("first.is_null").alias("__key_null"), F.col("first.__key_text").alias("__key_text")]
    members = checkpointed(groups.join(classes, "node").select("root", "node", *keys))
    code = F.xxhash64(*KEY_NAMES)
    rows = docs.select(*row_key(docs[text_col], docs[id_col]), docs[text_col].cast("binary").alias("text"))
    wanted = with_hit(rows, "__hit", code, hash_filter(members.select(code.alias("h")))).where("__hit").select(*KEY_NAMES, "text")
    sets = wanted.mapInArrow(_set_of, "__key_id long, __key_null boolean, __key_text long, hashes binary").dropDuplicates(KEY_NAMES)
    return checkpointed(sets.join(members, KEY_NAMES).select("root", "node", "hashes"))


def verified_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the similar nodes of each group."""
    blocks = F.ceil(F.sum(F.octet_length("hashes")) / BLOCK_BYTES).cast("long")
    groups = checkpointed(sets.groupBy("root").agg(F.greatest(blocks, F.lit(1)).alias("blocks")))
    placed = sets.join(groups, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    pieces = placed.select("root", "node", "hashes", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pieces = pieces.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "hashes")
    return pieces.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(_verified, "a long, b long")


def near_classes(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, first and best (the first row of its group) for each class of signatures()."""
    classes = checkpointed(rows.groupBy("node").agg(F.min(first_row()).alias("first"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words")))
    found = checkpointed(connected_components(candidate_links(classes.select("node", "words"))))
    groups = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    links = verified_links(member_sets(docs, classes.select("node", "first"), groups, id_col, text_col))
    return with_first(classes.select("node", "first", "n"), links, "node")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all columns."""
    rows = signatures(docs, id_col, text_col)
    return keep_rows(docs, decided(rows, near_classes(docs, rows, id_col, text_col), "node"), id_col, text_col)
