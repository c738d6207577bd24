"""Mixing overlapping sources to target weights by min-cost flow.

1. One pass over the texts leaves a narrow checkpointed table: id, size in
   words, membership pattern (the set of sources a document is in).
2. Documents are aggregated by pattern. Patterns and sources, not documents,
   go to the driver; more than ``max_patterns`` is an error, not a cut.
3. Targets share the words of all documents by weight and stop at
   ``max_repeats`` times their source's words; what is over is shared anew.
4. Min-cost flow routes each pattern's words to its sources' targets. Every
   further repetition of a pattern costs more than the one before (0, 1, 2 a
   word), so repetition is spread as evenly as the targets allow.
5. A pattern with flow f takes every document f div size times, and once more
   a seeded choice of documents that fills the rest: documents are dealt to
   buckets by a seeded hash, whole buckets are taken up to the one where the
   rest runs out, and in that one documents are taken in hash order as long as
   they fit, and a few swapped for a closer fit. No pattern's documents ever meet in one task, only one bucket's.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source and ranks last; ids may repeat or be null (a row's place
follows its id and text, so only rows alike in both share one); a text of any
length is counted whole; an empty table gives an empty result; other columns
aren't read, whatever their names. Reruns agree.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, split_words, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20
MAX_PATTERNS = 10_000
#: Documents expected in a bucket, of which one for each pattern is filled in one task.
BUCKET_DOCS = 4096

Pattern = tuple


def source_order(sources: Sequence) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, total: int | None = None) -> dict:
    """Words for each source: ``total`` (by default all sizes) by repeating weights, each at most max_repeats times its size."""
    order = source_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values()) if total is None else total
    found: dict = {}
    free, left = list(order), total
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > max_repeats * sizes[s]]
        if not over:
            return found | {s: weight[s] * share for s in free}
        for s in over:
            found[s] = float(max_repeats * sizes[s])
            left -= max_repeats * sizes[s]
        free = [s for s in free if s not in over]
    return found


def route(patterns: dict[Pattern, int], quotas: dict, max_repeats: int = MAX_REPEATS) -> dict[Pattern, int]:
    """Words that each pattern gives: a flow of least cost over pattern layers, sources and a sink.

    Layer k of a pattern (its k-th repetition) holds its size at cost k a
    word, so flow fills first repetitions before second ones wherever the
    quotas allow. Patterns of one source that no other pattern shares have no
    choice and are settled at once. For the others paths are found by length:
    the potentials make all shortest paths free, and a maximum flow over free
    edges (levels and blocking flows) uses all of them together, so the number
    of searches follows the few lengths that small integer costs have.
    """
    degree: dict = {}
    for p in patterns:
        for s in p:
            degree[s] = degree.get(s, 0) + 1
    settled = {p: min(int(quotas[p[0]]), max_repeats * n) for p, n in patterns.items() if len(p) == 1 and degree[p[0]] == 1}
    shared = {p: n for p, n in patterns.items() if p not in settled}
    return {p: settled[p] if p in settled else flow for p, flow in (settled | _flow(shared, quotas, max_repeats)).items()}


def _flow(patterns: dict[Pattern, int], quotas: dict, max_repeats: int) -> dict[Pattern, int]:
    graph: list[list[int]] = []
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)
        return len(to) - 2

    start, sink = node(), node()
    sources = source_order({s for p in patterns for s in p})
    source_node = {s: node() for s in sources}
    for s, n in source_node.items():
        edge(n, sink, int(quotas[s]), 0)
    layers: dict[Pattern, list[int]] = {}
    for p in sorted(patterns, key=lambda p: [(s is None, s or "") for s in p]):
        n = node()
        layers[p] = [edge(start, n, patterns[p], k) for k in range(max_repeats)]
        for s in p:
            edge(n, source_node[s], max_repeats * patterns[p], 0)
    potential = [0] * len(graph)
    while True:
        distance: list = [None] * len(graph)
        distance[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for e in graph[a]:
                if cap[e] > 0:
                    b, there = to[e], d + cost[e] + potential[a] - potential[to[e]]
                    if distance[b] is None or there < distance[b]:
                        distance[b] = there
                        heapq.heappush(heap, (there, b))
        if distance[sink] is None:
            return {p: sum(cap[e ^ 1] for e in es) for p, es in layers.items()}
        # Nodes beyond the sink move as far as it does, which keeps all reduced costs at zero or more.
        potential = [v + (distance[sink] if d is None else min(d, distance[sink])) for v, d in zip(potential, distance, strict=True)]
        _free_flow(graph, to, cap, cost, potential, start, sink)


def _free_flow(graph, to, cap, cost, potential, start: int, sink: int) -> None:
    """A maximum flow over edges without reduced cost."""
    free = lambda a, e: cap[e] > 0 and cost[e] + potential[a] - potential[to[e]] == 0
    while True:
        level = {start: 0}
        queue = [start]
        for a in queue:
            for e in graph[a]:
                if to[e] not in level and free(a, e):
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return
        at = dict.fromkeys(level, 0)
        path: list[int] = []
        a = start
        while True:
            if a == sink:
                most = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= most
                    cap[e ^ 1] += most
                full = next(i for i, e in enumerate(path) if not cap[e])
                a, path = to[path[full] ^ 1], path[:full]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if level.get(to[e]) == level[a] + 1 and free(a, e):
                    break
                at[a] += 1
            else:
                if a == start:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = to[e]


def fill(sizes: Sequence[int], counts: Sequence[int], left: int, swaps: int = 8) -> list[int]:
    """How many of each item to take: in order as long as they fit, then by swaps of a taken item for a larger one that use up more of what is left."""
    taken = []
    for size, n in zip(sizes, counts, strict=True):
        t = min(n, left // size) if size else 0
        left -= t * size
        taken.append(t)
    for _ in range(swaps):
        spare = sorted((size, i) for i, (size, n, t) in enumerate(zip(sizes, counts, taken, strict=True)) if t < n and size)
        best = (0, -1, -1)
        for i, size in enumerate(sizes):
            at = bisect_right(spare, (size + left, len(sizes))) - 1
            if taken[i] and at >= 0 and spare[at][0] - size > best[0]:
                best = (spare[at][0] - size, i, spare[at][1])
        if not best[0]:
            break
        left -= best[0]
        taken[best[1]] -= 1
        taken[best[2]] += 1
    return taken


@dataclass(frozen=True)
class Mix:
    """What was decided, as small tables for map-side joins."""

    plan: DataFrame
    picks: DataFrame


def _pattern(sources: str, docs: DataFrame) -> Column:
    """A document's pattern as JSON; a plain column is a set of one."""
    values = F.array_sort(F.array_distinct(F.col(sources))) if dict(docs.dtypes)[sources].startswith("array") else F.array(F.col(sources).cast("string"))
    return F.to_json(F.coalesce(values, F.array(F.lit(None).cast("string"))))


def tagged(docs: DataFrame, payload: list[str], id_col: str, text_col: str, sources: str, seed: int) -> DataFrame:
    """The payload with __id, __size, __pattern, __hash and __tie."""
    return docs.select(
        *[docs[c] for c in payload],
        docs[id_col].alias("__id"),
        F.size(split_words(docs[text_col])).cast("long").alias("__size"),
        _pattern(sources, docs).alias("__pattern"),
        F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("__hash"),
        F.xxhash64(docs[text_col]).alias("__tie"),
    )


def decide(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, max_patterns: int = MAX_PATTERNS, bucket_docs: int = BUCKET_DOCS) -> Mix:
    """The mix of tagged() rows, which are read three times."""
    spark = rows.sparkSession
    found = rows.groupBy("__pattern").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(json.loads(r["__pattern"])): (r["__pattern"], r["size"], r["n"]) for r in found}
    sizes: dict = {}
    for p, (_, size, _) in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    quotas = targets(sizes, weights, max_repeats, sum(size for _, size, _ in patterns.values()))
    flow = route({p: size for p, (_, size, _) in patterns.items()}, quotas, max_repeats)
    lines = []
    for p, (name, size, n) in patterns.items():
        full, rest = divmod(flow[p], size) if size else (0, 0)
        lines.append((name, full, rest, max(1, n // bucket_docs), sum(sizes[s] for s in p), float(sum(quotas[s] for s in p))))
    schema = "__pattern string, __full long, __rest long, __buckets long, source_size long, target double"
    plan = spark.createDataFrame(lines, schema)

    dealt = rows.join(F.broadcast(plan.where("__rest > 0")), "__pattern").withColumn("__bucket", bucket())
    sums = dealt.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("s"), F.first("__rest").alias("rest"))
    upto = F.sum("s").over(Window.partitionBy("__pattern").orderBy("__bucket"))
    edge = sums.select("*", upto.alias("c")).where("c > rest and c - s <= rest").select("__pattern", F.col("__bucket").alias("__edge"), (F.col("rest") - F.col("c") + F.col("s")).alias("left"))
    edge = checkpointed(edge)
    plan = plan.join(F.broadcast(edge.select("__pattern", "__edge")), "__pattern", "left")
    at_edge = dealt.join(F.broadcast(edge), (dealt["__pattern"] == edge["__pattern"]) & (dealt["__bucket"] == edge["__edge"])).drop(edge["__pattern"])
    alike = at_edge.groupBy("__pattern", "__hash", "__id", "__size").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))

    def run(pdf):
        pdf = pdf.sort_values(["__hash", "__id", "__size"], kind="stable")
        return pdf.assign(__more=fill(pdf["__size"].tolist(), pdf["n"].tolist(), int(pdf["left"].iloc[0])))[["__pattern", "__hash", "__id", "__size", "__more"]].query("__more > 0")

    id_type = dict(rows.dtypes)["__id"]
    picks = checkpointed(alike.groupBy("__pattern").applyInPandas(run, f"__pattern string, __hash long, __id {id_type}, __size long, __more long"))
    return Mix(plan, picks)


def bucket() -> Column:
    return F.pmod("__hash", "__buckets")


def with_repeats(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds __repeats, source_size and target to tagged() rows. Only rows of edge buckets are shuffled."""
    joined = rows.join(F.broadcast(mix.plan), "__pattern", "left").withColumn("__bucket", bucket())
    at_edge = F.col("__bucket").eqNullSafe(F.col("__edge"))
    more = F.when((F.col("__rest") > 0) & ((F.col("__bucket") < F.col("__edge")) | F.col("__edge").isNull()), 1).otherwise(0)
    plain = joined.where(~at_edge).withColumn("__repeats", F.col("__full") + more)
    alike = Window.partitionBy("__pattern", "__hash", "__id", "__size").orderBy("__tie")
    names = ["__pattern", "__hash", "__id", "__size"]
    picks = mix.picks.select(*[F.col(c).alias(f"{c}_p") for c in names], "__more")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_p")) for c in names]
    edge = joined.where(at_edge).withColumn("__nth", F.row_number().over(alike)).join(picks, same[0] & same[1] & same[2] & same[3], "left")
    edge = edge.withColumn("__repeats", F.col("__full") + F.when(F.col("__nth") <= F.col("__more"), 1).otherwise(0))
    return plain.unionByName(edge.select(*plain.columns))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, repeats, taken. With overlapping sources source_size and target are sums over the document's sources."""
    rows = checkpointed(tagged(docs, [], id_col, text_col, sources, seed))
    found = with_repeats(rows, decide(rows, weights, max_repeats))
    return found.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", F.col("__repeats").cast("long").alias("repeats"), (F.col("__size") * F.col("__repeats")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, with their columns, as often as it takes them. Texts of edge buckets alone are shuffled."""
    rows = checkpointed(tagged(docs, [], id_col, text_col, sources, seed))
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__i"), docs[text_col].alias("__t"), docs[sources].alias("__s"))
    found = with_repeats(tagged(inner, ["__row"], "__i", "__t", "__s", seed), decide(rows, weights, max_repeats))
    copies = found.where("__repeats > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__repeats").cast("int"))))
    return copies.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: Filling a bucket takes each document in turn as long as it fits; tests compare with brute force.
ORACLE = None
