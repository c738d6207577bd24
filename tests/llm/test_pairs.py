"""Exact and near deduplication, components and the trie against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import common, exact_dedup, simhash
from granary.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    (5, "Alpha beta  gamma\ndelta epsilon zeta"), (2, "Alpha betagamma delta\tepsilon zeta "), (9, None), (1, ""), (4, " \n\x0b\x0c\r\t"), (7, "x"), (8, "x"), (3, "é ß   non"), (6, "The quick brown fox jumps over the lazy dog again"),
    (11, "the QUICK brown fox jumps over the lazy dog again"), (None, "x"), (7, "x"), (12, " ".join(f"w{i}" for i in range(3000))), (13, " ".join(f"w{i}" for i in range(2999)) + " end"), (14, "one two three"), (None, None),
]


def frame(spark, rows=TEXTS, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("summary_size", [2, 1000])
def test_exact_dedup_by_brute_force(spark, summary_size):
    rows = exact_dedup.exact_dedup(frame(spark).repartition(3), summary_size=summary_size).collect()
    groups: dict = {}
    for i, t in TEXTS:
        groups.setdefault(normal(t), []).append((i, t))
    assert len(rows) == len(TEXTS)
    for key, members in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        got = [r for r in rows if r.text_sha256 == digest]
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        assert {r.keep_id for r in got} == {best} and {r.group_size for r in got} == {len(members)} and len(got) == len(members)
        assert [r.doc_id for r in got if r.kept] == [best]


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = frame(spark).withColumn("kept", F.lit("mine")).withColumn("keep_id", F.lit(1)).withColumn("digest", F.lit(2))
    left = exact_dedup.without_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len({normal(t) for _, t in TEXTS})
    assert exact_dedup.without_exact_copies(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_hot_digest_is_found_and_broadcast(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.digests(docs)
    heavy = exact_dedup.verified_winners(rows, exact_dedup.frequent_digests(rows, 10)).collect()
    assert [(r.group_size, r.keep_id) for r in heavy] == [(1000, 0)]
    assert exact_dedup.resolve(rows, 10).where("kept").count() == 2001


def test_fingerprints(spark):
    for _, t in TEXTS:
        got = simhash.fingerprint(t.encode() if t is not None else None)
        assert got % (1 << 64) == slow_fingerprint(t)


def test_near_duplicates_by_brute_force(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    for (i, _), fp, root in zip(rows, fps, roots, strict=True):
        assert got[i, f"{fp:016x}"] == min(rows[k][0] for k in range(len(rows)) if roots[k] == root)
    assert got[9, "0" * 16] == got[1, "0" * 16] == 1


def test_near_duplicates_edge_cases(spark):
    docs = frame(spark).withColumn("fp", F.lit("mine")).withColumn("fingerprint", F.lit(0))
    assert simhash.near_duplicates(docs).count() == len(TEXTS)
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len(set(slow_components([slow_fingerprint(t) for _, t in TEXTS])))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.without_near_copies(docs.limit(0)).count() == 0
    only_null = frame(spark, [(None, "a b c d e"), (None, "a b c d e")])
    assert [r.component_id for r in simhash.near_duplicates(only_null).collect()] == [None, None]


def test_documents_on_the_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    roots = slow_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[k].doc_id) for r, f, k in zip(rows, fps, roots, strict=True)}


def near_values(seed, n=200):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    return sorted({c ^ sum(1 << int(p) for p in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for c in centres for _ in range(n // 12)})


def linked(n, pairs):
    """Root of each place under links of places."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def as_signed(fps):
    return [f - (1 << 64) * (f >> 63) for f in fps]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("traversed", [2048, 8])
def test_trie_links_by_brute_force(seed, traversed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)  # so that the traversal is cut into parts
    monkeypatch.setattr(simhash, "TRAVERSED", traversed)  # so that sub-tries are split within the task
    fps = near_values(seed)
    signed = as_signed(fps)
    a, b = simhash.trie_links(np.zeros(len(fps), np.int64), np.array(signed, np.int64))
    place = {f: i for i, f in enumerate(signed)}
    assert linked(len(fps), [(place[x], place[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]) == slow_components(fps)


def test_one_dense_sub_trie_is_split():
    """Fingerprints that share 22 leading bits: the same links as brute force has among some of them, in a few seconds."""
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**42, 60_000, dtype=np.uint64) | np.uint64(0x2AAAAA << 42))
    near = fps[:300] ^ np.uint64(0b1011)
    fps = np.unique(np.concatenate([fps, near]))
    a, b = simhash.trie_links(np.full(len(fps), simhash.signed(((1 << 22) - 1) << 42), np.int64), fps.view(np.int64))
    root = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if find(x) != find(y):
            root[find(x)] = find(y)
    signed = fps.view(np.int64)
    some = rng.choice(len(fps), 400, replace=False).tolist() + np.searchsorted(fps, near).tolist()
    for i in some:
        close = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        assert len({find(int(signed[k])) for k in close}) == 1
        assert len(close) > 1 or int(signed[i]) not in root


@pytest.mark.parametrize("hot_rows,chunk", [(200_000, 200_000), (4, 40)])
def test_class_links_with_and_without_split_sub_tries(spark, monkeypatch, hot_rows, chunk):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(simhash, "MAX_BROADCAST", 3)
    fps = near_values(9)
    signed = as_signed(fps)
    if hot_rows == 4:
        masks = simhash.block_masks(4)
        entries = spark.createDataFrame([(m, f & m) for f in signed for m in masks], "mask long, key long")
        want = {k for k, n in Counter((m, f & m) for f in signed for m in masks).items() if n > 4}
        assert {tuple(r) for r in simhash.hot_keys(entries, ["mask", "key"], 10**6).collect()} == want and want
    links = simhash.class_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    groups = slow_components(fps)
    want = {s: min(signed[k] for k in range(len(fps)) if groups[k] == g) for s, g in zip(signed, groups, strict=True)}
    assert roots == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("clean", [3, 4])
def test_more_clean_blocks_link_the_same(spark, clean):
    fps = near_values(10)
    signed = as_signed(fps)
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want, got = (sorted(map(tuple, connected_components(simhash.class_links(classes, clean=c)).collect())) for c in (2, clean))
    assert want == got and want


def test_clean_blocks_follow_the_number_of_classes():
    assert [simhash.clean_blocks(n, 4) for n in (0, 10**6, 10**9, 10**11)] == [2, 2, 3, 4]


@pytest.mark.parametrize("clean", [2, 3, 4])
def test_blocks_cover_every_error_pattern(clean):
    rng = np.random.default_rng(3)
    masks = simhash.block_masks(4, clean)
    for _ in range(500):
        errors = sum(1 << int(p) for p in rng.choice(64, 4, replace=False))
        assert any(not m & errors for m in masks)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 80)}}
    assert connected_components(links.limit(0)).count() == 0


def test_keep_rows_by_brute_force(spark, monkeypatch):
    rows = [(i if i % 11 else None, f"t{i % 37}" if i % 13 else None) for i in range(400)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit(1)).withColumn("__key_id", F.lit("x")).withColumn("__at", F.lit(2))
    keep = {r for r in rows if hash(str(r)) % 3}
    decided = spark.createDataFrame([(*r, r in keep) for r in rows] + [(*r, False) for r in keep], "doc_id long, text string, __kept boolean")
    decided = decided.select(*common.row_key(decided["text"], decided["doc_id"]), "__kept")
    for bits in (15, 17, 27):  # so few that most rows hit
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        left = common.keep_rows(docs, decided)
        got = Counter((r.doc_id, r.text) for r in left.collect())
        assert left.columns == docs.columns and got == Counter(keep)


def test_hash_filter_never_misses(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 32767, 32768, *range(1000, 90_000, 777)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    found = common.hash_filter(rows, 20)
    assert common.with_hit(rows, "hit", F.col("v"), found).where("not hit").count() == 0
    others = spark.range(200_000, 210_000).select(F.col("id").alias("v"))
    assert common.with_hit(others, "hit", F.col("v"), found).where("hit").count() == sum(v % 2**20 in {x % 2**20 for x in values} for v in range(200_000, 210_000))
