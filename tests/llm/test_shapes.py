"""Packing, sharding, mixing, WARC and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.llm import common, exact_dedup, mixing, packing, quality_rules, sharding, simhash, warc
from tests.helpers import assert_same
from tests.llm.test_near_copies import slow_kept

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """(doc_id, words, source) rows; words None: null text."""
    lines = [(i, None if n is None else " ".join(f"w{k}" for k in range(n)), "en", s, 1) for i, n, s in rows]
    return spark.createDataFrame(lines, SCHEMA).withColumn("size", F.lit("mine")).withColumn("bits", F.lit(0)).withColumn("seq_id", F.lit(0)).withColumn("repeats", F.lit(0))


# Packing


ITEMS = [(1, 5000, "a"), (2, 4096, "a"), (3, None, "a"), (4, 0, "a"), (None, 300, "a"), (5, 300, "a"), (5, 300, "a"), (6, 256, None), (7, 1, "b"), (8, 12_300, "b"), (9, 255, "b")] + [(100 + i, 17 * i % 900 + 1, "c") for i in range(200)]


def test_packing_holds_every_word_once(spark):
    found = packing.pack_documents(frame(spark, ITEMS), group_items=50).collect()
    words = Counter()
    for r in found:
        words[r.doc_id] += r.piece_words
    assert all(words[i] == sum(n or 0 for j, n, _ in ITEMS if j == i) for i, _, _ in ITEMS)
    bins = defaultdict(list)
    for r in found:
        assert (r.seq_id is None) == (r.n_words == 0)
        if r.seq_id:
            bins[r.seq_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.seq_offset)
        at = 0
        for r in rows:
            assert r.seq_offset == at and r.piece_start == r.piece * max(packing.LENGTHS)
            at += r.piece_words
        assert at == rows[0].seq_used <= rows[0].seq_capacity
        assert rows[0].seq_capacity == min(c for c in packing.LENGTHS if c >= at)


def slow_best_fit(lengths, choose):
    rooms, used, bins = [], [], []
    for i, n in enumerate(lengths):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= n]
        room = min(fits)[0] if fits else None
        if room is None:
            rooms.append(choose(i) - n)
            used.append(n)
            bins.append(len(used) - 1)
        else:
            b = max(b for r, b in fits if r == room)
            rooms[b] -= n
            used[b] += n
            bins.append(b)
    return sorted(used)


def test_best_fit_by_brute_force():
    import random

    for seed in range(20):
        lengths = sorted((random.Random(seed * 100 + i).randint(1, 64) for i in range(60)), reverse=True)
        for cap in (64, 128):
            _, used = packing.best_fit(lengths, lambda i, cap=cap: cap)
            slow = slow_best_fit(lengths, lambda i, cap=cap: cap)
            assert sorted(used) == slow and sum(used) == sum(lengths) and max(used) <= cap


def test_joint_lengths_cost_no_more_than_one(spark):
    lengths = sorted((17 * i % 900 + 1 for i in range(400)), reverse=True)
    _, used, sizes = packing.pack(lengths)
    joint = sum(map(packing.sequence_cost, sizes))
    for cap in (1024, 2048, 4096):
        _, one = packing.best_fit(lengths, lambda i, cap=cap: cap)
        assert joint <= len(one) * packing.sequence_cost(cap)
    assert all(u <= s for u, s in zip(used, sizes, strict=True))


def test_packing_empty_and_reruns(spark):
    docs = frame(spark, ITEMS)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert sorted(map(str, packing.pack_documents(docs).collect())) == sorted(map(str, packing.pack_documents(docs).collect()))


# Sharding


def test_sharding_matches_sql(spark, duck):
    found = sharding.query(spark, DATA)
    assert_same(found, duck.sql(sharding.ORACLE))
    facts = found.agg(F.count_distinct("shard").alias("n"), F.count_distinct("depth").alias("d")).first()
    assert facts.n > 8 and facts.d > 1


@pytest.mark.parametrize("limit", [20_000, 3_000, 300])
def test_shards_by_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_CELL_BITS", 6)  # so that several rounds are needed
    rows = [(i, 13 * i % 90, "s") for i in range(300)] + [(7, 50, "s")] * 40 + [(None, None, "s"), (400, 0, "s"), (500, 9000, "s")]
    docs = frame(spark, rows)
    keyed = sorted((r.bits, r.bytes) for r in sharding.keyed(docs, limit=limit)[1].collect())
    found = sharding.shards(docs, limit=limit).collect()
    assert len(found) == len(rows)
    want = []
    for bits, _ in keyed:
        for depth in range(161):
            inside = [b for k, b in keyed if k.startswith(bits[:depth])]
            if sum(inside) <= limit or len(inside) == 1 or depth == 160:
                want.append((bits[:depth], sum(inside), len(inside)))
                break
    assert len(want) == len(rows) and any(int(b[96:], 2) for b, _ in keyed) == (40 * 189 > limit)
    assert Counter((r.shard, r.shard_bytes, r.shard_docs) for r in found) == Counter(want)
    assert all(r.depth == len(r.shard) and (r.shard_bytes <= limit or r.shard_docs == 1) for r in found)


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, 13 * i % 90, "s") for i in range(200)] + [(7, 91, "s")] * 3 + [(None, None, "s")])
    sharding.write_shards(docs, str(tmp_path / "out"), limit=5000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and len(list((tmp_path / "out").glob("__shard=*"))) > 5
    assert sharding.shards(docs.limit(0)).count() == 0


# Mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3 * sizes[s] for s in capped}, **share}
        capped |= over


MIXED = [(i, 5 + 37 * i % 211, ["beta", "alpha", None, "Zed", "é", "alpha"][i % 6]) for i in range(600)] + [(9000, 40, "tiny"), (9001, None, "tiny"), (None, 30, "alpha"), (3, 5 + 37 * 3 % 211, "Zed")]


def test_mix_by_contract(spark):
    found = mixing.mix_sources(frame(spark, MIXED)).collect()
    sizes = Counter()
    for _, n, s in MIXED:
        sizes[s] += n or 0
    want = slow_targets(sizes)
    by_size = {sizes[s]: s for s in want}
    assert len(by_size) == len(want)
    assert len(found) == len(MIXED)
    taken = Counter()
    for r in found:
        source = by_size[r.source_size]
        assert abs(r.target - want[source]) < 1e-6 and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(0 <= want[s] - taken[s] < 8 for s in want), (want, taken)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_sources(frame(spark, MIXED).repartition(5)).collect()))


def test_mixed_documents_repeat_as_decided(spark):
    docs = frame(spark, MIXED)
    repeats = {}
    for r in mixing.mix_sources(docs).where("doc_id is not null and doc_id <> 3").collect():
        repeats[r.doc_id] = r.repeats
    left = mixing.mixed_documents(docs)
    assert left.columns == docs.columns
    got = Counter(r.doc_id for r in left.select("doc_id").collect() if r.doc_id not in (None, 3))
    assert all(got[i] == n for i, n in repeats.items())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.limit(0)).count() == 0


def test_small_buckets_fill_as_well(spark):
    rows = mixing.checkpointed(mixing.tagged(frame(spark, MIXED), [], "doc_id", "text", "source", 1))
    found = mixing.with_repeats(rows, mixing.decide(rows, bucket_docs=16)).groupBy("__pattern").agg(F.sum(F.col("__size") * F.col("__repeats")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(0 <= r.target - r.taken < 120 for r in found)


def test_rows_without_ids_are_dealt_by_their_texts(spark):
    texts = F.concat_ws(" ", "text", F.concat(F.lit("own"), F.col("doc_id").cast("string")))
    docs = frame(spark, MIXED[:600]).withColumn("text", texts).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.checkpointed(mixing.tagged(docs, [], "doc_id", "text", "source", 1))
    assert rows.select("__hash").distinct().count() == 600
    taken = mixing.with_repeats(rows, mixing.decide(rows, bucket_docs=16)).groupBy("__pattern").agg(F.sum(F.col("__size") * F.col("__repeats")).alias("taken"), F.first("target").alias("target"))
    assert all(0 <= r.target - r.taken < 120 for r in taken.collect())


def test_overlapping_sources(spark):
    docs = frame(spark, [(i, 50, "x") for i in range(300)]).withColumn("source", F.when(F.col("doc_id") < 100, F.array(F.lit("a"))).when(F.col("doc_id") < 200, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"))))
    found = mixing.mix_sources(docs, weights=(2, 1)).collect()
    assert sum(r.taken for r in found) == 300 * 50 and {r.repeats for r in found} == {1}
    with pytest.raises(ValueError):
        rows = mixing.tagged(docs, [], "doc_id", "text", "source", 1)
        mixing.decide(rows, max_patterns=2)


def slow_cost(patterns, quotas, flows):
    return sum(sum(max(0, min(flow - k * patterns[p], patterns[p])) * k for k in range(3)) for p, flow in flows.items())


def test_flow_is_feasible_and_cheapest():
    import itertools

    patterns, quotas = {("a",): 4, ("a", "b"): 3, ("b",): 2}, {"a": 9, "b": 7}
    flows = mixing.route(patterns, quotas)
    assert sum(flows.values()) == 16
    best = None
    for x, y, z in itertools.product(range(13), range(10), range(7)):
        if x + y + z == 16 and x <= 9 and z <= 7:
            cost = slow_cost(patterns, quotas, {("a",): x, ("a", "b"): y, ("b",): z})
            best = cost if best is None else min(best, cost)
    assert slow_cost(patterns, quotas, flows) == best


# WARC


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, "http://a", "<p>x</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é WARC/1.1\r\n\r\n\r\n\r\nend\r\n\r\n"), (None, "http://e", "alone"), (7, "http://f", "same"), (7, "http://f", "same"), (6, "http://g", "same")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).withColumn("bytes", F.lit("mine"))
    warc.write_warc(pages, str(tmp_path / "w"))
    records = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(records) == len(PAGES) and all(r.digest_ok for r in records)
    found = Counter(map(tuple, warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()))
    want = Counter()
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[(html or "").encode()].append(i)
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            want[(i, len(payload), digest, "revisit" if k else "response", ids[0] if k else None)] += 1
    assert found == want
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("part-*"))
    assert data.count(b"<p>x</p>") == 1
    parts = [x for p in Path(tmp_path / "w").glob("part-*") for x in warc.members(p.read_bytes())]
    kinds = [h["warc-type"] for x in parts for h, _ in [*warc.parse(x)]]
    assert len(parts) == len(kinds) == len(PAGES) + kinds.count("warcinfo") and kinds.count("warcinfo") == sum(p.stat().st_size > 0 for p in Path(tmp_path / "w").glob("part-*"))
    assert len({r.record_id for r in records}) == len(records)


def test_warc_short_payloads_and_giants(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "xy"), (2, "u", "xy"), (3, "u", "long enough"), (4, "u", "long enough"), (5, "u", "z" * (5 << 20))], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), min_bytes=5)
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    warc.write_warc(pages.where("page_id = 3"), str(tmp_path / "w"))
    assert [r.page_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect()] == [3]


def test_warc_archives_are_bounded_and_members_end_with_zero(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("né "), (F.col("id") * 7 % 900).cast("int")).alias("html")).coalesce(2)
    pages = pages.unionByName(spark.createDataFrame([(900, "u", "x" * (17 << 20))], pages.schema))
    monkeypatch.setattr(warc, "hash_filter", lambda rows: common.hash_filter(rows, 15))
    warc.write_warc(pages, str(tmp_path / "w"))
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    sizes = [[len(x) for x in warc.members(data)][1:] for data in files]
    assert len(files) > 10 and all(sum(s) <= 20_000 or len(s) == 1 for s in sizes) and max(map(max, sizes)) > 16 << 20
    assert all(data[-1] == 0 for data in files)
    got = {r.page_id: r for r in warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    texts = {r.page_id: r.html for r in pages.collect()}
    for i, text in texts.items():
        first = max(k for k, t in texts.items() if t == text)
        assert (got[i].payload_bytes, got[i].record_type, got[i].refers_to) == (len(text.encode()), *(("response", None) if i == first else ("revisit", first)))


def test_warc_empty_and_sql(spark, duck, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "w"))
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0
    assert_same(warc.query(spark, DATA), duck.sql(warc.ORACLE))


# Pipeline


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()} == kept
    stage = docs.where(F.col("doc_id").isin(list(kept)))
    groups = defaultdict(list)
    for i in kept:
        groups["".join(texts[i].split())].append(i)
    unique = {max(ids, key=lambda i: (len(texts[i]), -i)) for ids in groups.values()}
    assert {r.doc_id for r in exact_dedup.without_exact_copies(stage).collect()} == unique
    stage = docs.where(F.col("doc_id").isin(list(unique)))
    first = {r.component_id for r in simhash.near_duplicates(stage).collect()}
    assert {r.doc_id for r in simhash.without_near_copies(stage).collect()} == first
    stage = docs.where(F.col("doc_id").isin(slow_kept(sorted((i, texts[i]) for i in unique))))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(stage).collect())
    packed = Counter()
    for r in corpus_pipeline.run(spark, DATA).collect():
        packed[r.doc_id] += r.piece_words
    assert packed == Counter({i: n * len(texts[i].split()) for i, n in mixed.items()})
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
