"""The pipeline's near-dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from granary.llm import exact_dedup, mixing, near_copies, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The smallest id of each component at a similarity of 0.8 or more."""
    sets, kept = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while kept[x] != x:
            x = kept[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                kept[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def variants(seed):
    rng, rows = random.Random(seed), []
    for k in range(30):
        words = [f"{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        rows.append(" ".join(words))
        for _ in range(rng.randrange(0, 5)):
            other = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 30))):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    rows += [None, "", " \n", "one two", "One  two", "one two three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_near_stage_by_brute_force(spark, seed):
    rows = variants(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    left = corpus_pipeline.near_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == slow_kept(rows) and len(slow_kept(rows)) < len(rows)


def test_near_stage_on_the_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == slow_kept(rows)


def test_pipeline_packs_what_brute_force_leaves(spark):
    folder = "/root/testdata/sf0.01"
    docs = exact_dedup.without_exact_copies(quality_rules.without_rejected(spark.read.parquet(f"{folder}/documents.parquet"))).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = slow_kept(sorted(texts.items()))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs.where(F.col("doc_id").isin(kept))).collect())
    packed = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        packed[r.doc_id] += r.piece_words
    assert len(kept) < len(texts) and packed == Counter({i: n * len(texts[i].split()) for i, n in mixed.items()})


def test_repeated_rows_null_ids_and_chains(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[5 * k : 5 * k + 200]) for k in range(8)]  # neighbours are similar, the ends aren't
    rows = [(k, t) for k, t in enumerate(chain)] + [(None, chain[3]), (0, chain[0]), (9, "alone and by itself here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.without_near_copies(docs).collect()) == [0, 9]
    only_null = docs.where("doc_id is null")
    assert only_null.count() == near_copies.without_near_copies(only_null).count() == 1
