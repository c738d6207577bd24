"""Variable-capacity best-fit packing of documents into sequences.

A document is one item; one longer than the largest permitted length is first
cut into pieces of that length and a rest. Full pieces are sequences of their
own; all others are dealt by a seeded hash into groups of about
``group_items`` and packed there, longest first: an item goes to the open bin
with the least room that holds it, else it opens a bin.

The permitted lengths are optimised jointly: each group is packed under
several opening rules (the size of least cost for each word that is expected
to fill it, and each permitted length as the standing choice), every bin is
downsized to the smallest permitted length that holds its contents, and the
rule whose downsized bins cost least is kept.

A group's items are (id, length) pairs, never texts, so a group is a few
hundred kilobytes at any input size.

Defined results: a null or empty text has no words and gets a row with
seq_id null; ids may repeat or be null (each row is an item of its own); a text
of any length is cut into pieces; of items of one length the one with the
smaller seeded hash comes first, of bins with equal room the latest is filled,
of rules of equal cost the first is kept; an empty table gives an empty result;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, split_words, table

LENGTHS = (256, 512, 1024, 2048, 4096)
GROUP_ITEMS = 20_000
SEED = 10
#: Cost of a sequence: its length, attention over it, and a fixed part.
ATTENTION = 1 / 65_536
FIXED = 8.0

SCHEMA = "doc_id long, n_words long, piece long, piece_start long, piece_words long, seq_id string, seq_capacity long, seq_used long, seq_offset long"


def sequence_cost(length: int) -> float:
    return FIXED + length + ATTENTION * length * length


def _cost_rule(lengths: Sequence[int], caps: Sequence[int]) -> Callable[[int], int]:
    """Opens the size of least cost for each expected word: the item and the later ones that could fill the room, all lengths descending."""
    after = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i]
    negative = [-x for x in lengths]

    def choose(i: int) -> int:
        best, least = 0, float("inf")
        for c in caps:
            room = c - lengths[i]
            if room < 0:
                continue
            fill = lengths[i] + min(room, after[max(i + 1, bisect_left(negative, -room))] if room else 0)
            if (price := sequence_cost(c) / fill) < least:
                best, least = c, price
        return best

    return choose


def _standing_rule(lengths: Sequence[int], caps: Sequence[int], standing: int) -> Callable[[int], int]:
    return lambda i: max(standing, caps[bisect_left(caps, lengths[i])])


def best_fit(lengths: Sequence[int], choose: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """Bin of each item and contents of each bin; lengths descend. The bits of ``rooms`` tell which amounts of room open bins have."""
    rooms, by_room = 0, {}
    bins, used = [], []
    for i, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(used), choose(i)
            used.append(0)
        used[b] += n
        bins.append(b)
        if room > n:
            if not by_room.setdefault(room - n, []):
                rooms |= 1 << (room - n)
            by_room[room - n].append(b)
    return bins, used


def downsized(used: int, caps: Sequence[int]) -> int:
    return caps[bisect_left(caps, used)]


def pack(lengths: Sequence[int], caps: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item, contents and capacity of each bin, for descending lengths of at most max(caps)."""
    caps = sorted(caps)
    rules = [_cost_rule(lengths, caps), *(_standing_rule(lengths, caps, c) for c in caps)]
    best = None
    for choose in rules:
        bins, used = best_fit(lengths, choose)
        sizes = [downsized(u, caps) for u in used]
        cost = sum(map(sequence_cost, sizes))
        if best is None or cost < best[0]:
            best = cost, bins, used, sizes
    return best[1:]


def _pack_group(caps: Sequence[int]):
    def run(pdf):
        pdf = pdf.sort_values(["piece_words", "__order", "__rid"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, used, sizes = pack(pdf["piece_words"].tolist(), caps)
        offset, at = [], [0] * len(used)
        for b, n in zip(bins, pdf["piece_words"].tolist(), strict=True):
            offset.append(at[b])
            at[b] += n
        name = f"g{pdf['__group'].iloc[0]}-"
        pdf = pdf.assign(seq_id=[f"{name}{b}" for b in bins], seq_capacity=[sizes[b] for b in bins], seq_used=[used[b] for b in bins], seq_offset=offset)
        return pdf[[c.split()[0] for c in SCHEMA.split(", ")]]

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caps: Sequence[int] = LENGTHS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A row for each piece of a document: SCHEMA. seq_offset is where in its sequence the piece starts, in words."""
    top = max(caps)
    sized = checkpointed(
        docs.select(docs[id_col].cast("long").alias("doc_id"), F.size(split_words(docs[text_col])).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("__rid"))
    )
    n_rest = sized.where(F.col("n_words") % top > 0).count()
    groups = max(1, -(-n_rest // group_items))
    whole = F.expr(f"n_words div {top}L")
    cut = sized.where(F.col("n_words") >= top).select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = cut.select(
        "doc_id", "n_words", "piece", (F.col("piece") * top).alias("piece_start"), F.lit(top).cast("long").alias("piece_words"),
        F.concat_ws("-", F.lit("f"), F.col("__rid").cast("string"), F.col("piece").cast("string")).alias("seq_id"), F.lit(top).cast("long").alias("seq_capacity"), F.lit(top).cast("long").alias("seq_used"), F.lit(0).cast("long").alias("seq_offset"),
    )
    order = F.xxhash64("doc_id", "n_words", "__rid", F.lit(SEED))
    rest = sized.where(F.col("n_words") % top > 0).select(
        "doc_id", "n_words", whole.alias("piece"), (whole * top).alias("piece_start"), (F.col("n_words") % top).alias("piece_words"), "__rid", order.alias("__order"), F.pmod(order, F.lit(groups)).alias("__group")
    )
    packed = rest.groupBy("__group").applyInPandas(_pack_group(caps), SCHEMA)
    none = F.lit(None).cast("long")
    empty = sized.where("n_words = 0").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("piece_words"), F.lit(None).cast("string").alias("seq_id"), none.alias("seq_capacity"), none.alias("seq_used"), none.alias("seq_offset")
    )
    return packed.unionByName(full).unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


#: Best-fit is sequential; tests compare with brute force.
ORACLE = None
