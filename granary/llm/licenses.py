"""License scans by diagonal voting.

1. Templates are word sequences, short phrases or longer notices. Their rolling
   k-gram codes, with positions, make a small fixed table that is broadcast.
2. Each text's rolling k-grams are coded over the templates' vocabulary; a
   gram with a word outside it can match nothing and isn't posted. A code is
   the base-V number of its words' places, so equal codes mean equal words.
3. Spark joins the grams to template positions. A match at word i of a text and
   word j of a template votes for the diagonal i - j.
4. Votes are counted by text, template and diagonal, and neighbouring
   diagonals (insertions, deletions) are merged: those of a notice once within
   NEIGHBOURS words and once within half its length, so that a long insertion
   doesn't part a notice and scattered votes don't spoil a compact one.
5. Spans are verified: a phrase needs all its grams on one diagonal, which is
   exact; a notice needs MIN_COVER of its gram positions, each counted once, in
   a span of at most MAX_STRETCH times its length.

Texts aren't shuffled, only votes are, and those of one text never outnumber
its words by more than the templates' repeats. Rows are told apart by a row id
that one pass gives and carries through.

Defined results: a null text counts as empty and has no labels and score 0;
ids may repeat or be null; labels are sorted by code point; a text of any
length is coded whole, by one task, and only its grams that some template has
travel further; an empty table gives an empty result; other columns aren't
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import table

#: Octets of a lower-cased text to words: A-Z fold, other ASCII outside 0-9 and a-z separates, all else stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MIN_COVER = 0.5
MAX_STRETCH = 2.0
#: Diagonals of a notice that are at most this far apart belong to one span.
NEIGHBOURS = 4


@dataclass(frozen=True)
class Template:
    """A license text. Base phrases count as places; notices and other phrases add labels."""

    label: str
    text: str
    k: int = 2
    base: bool = False
    exact: bool = True

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().translate(FOLD).split()


# Phrases and the opening words of license notices.
TEMPLATES = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        k=4,
        exact=False,
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        k=4,
        exact=False,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        k=4,
        exact=False,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        k=4,
        exact=False,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        k=4,
        exact=False,
    ),
]


def vocabulary(templates: Sequence[Template]) -> dict[bytes, int]:
    """A place from 1 for each word of the templates; 0 is any other word."""
    return {w: i + 1 for i, w in enumerate(sorted({w for t in templates for w in t.words}))}


def gram_codes(places, k: int, base: int):
    """Positions of the k-grams without a place 0, and their codes, from an array of places."""
    import numpy as np

    if len(places) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(places) - k + 1
    code, whole = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = places[j : j + n]
        code = code * base + part
        whole &= part > 0
    at = np.flatnonzero(whole)
    return at, code[at]


def template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """k, code, template, tpos: a row for each gram position of each template."""
    import numpy as np

    words = vocabulary(templates)
    base = len(words) + 1
    if max((t.k for t in templates), default=0) * base.bit_length() > 62:
        raise ValueError("the templates' vocabulary is too large for exact gram codes")
    lines = []
    for i, t in enumerate(templates):
        at, code = gram_codes(np.array([words[w] for w in t.words], np.int64), t.k, base)
        lines += [(t.k, int(c), i, int(p)) for p, c in zip(at, code, strict=True)]
    return spark.createDataFrame(lines, "k int, code long, template int, tpos long")


def _posted(templates: Sequence[Template]):
    words = vocabulary(templates)
    ks = sorted({t.k for t in templates})
    base = len(words) + 1
    # A gram of k words can only match templates of that k.
    of_k = {k: {words[w] for t in templates if t.k == k for w in t.words} for k in ks}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = {k: np.isin(np.arange(base), sorted(v)) for k, v in of_k.items()}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, docs = batch.column("rid").to_numpy(), batch.column("doc_id")
            for row, text in enumerate(batch.column("text")):
                tokens = (text.as_py() or b"").translate(FOLD).split()
                places = np.fromiter((words.get(w, 0) for w in tokens), np.int64, len(tokens))
                parts = [(np.array([len(tokens)]), np.array([-1]), 0)]
                for k in ks:
                    at, code = gram_codes(np.where(known[k][places], places, 0), k, base)
                    parts.append((at, code, k))
                n = sum(len(p[0]) for p in parts)
                out[0].append(np.full(n, ids[row]))
                out[1].append(np.full(n, row))
                out[2].append(np.concatenate([p[0] for p in parts]))
                out[3].append(np.concatenate([p[1] for p in parts]))
                out[4].append(np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts]))
            if out[0]:
                rid, row, pos, code, k = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(rid), docs.take(pa.array(row)), pa.array(pos), pa.array(code), pa.array(k.astype(np.int32))], names=["rid", "doc_id", "pos", "code", "k"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: (label, start, stop, score) in words."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    grams = rows.mapInArrow(_posted(templates), "rid long, doc_id long, pos long, code long, k int")
    positions = template_table(spark, templates)
    facts = spark.createDataFrame(
        [(i, t.label, t.base, t.exact, len(t.words), max(1, len(t.words) - t.k + 1), t.k) for i, t in enumerate(templates)],
        "template int, label string, base boolean, exact boolean, words long, grams long, size int",
    )
    # k = 0 marks the row that stands for the document itself, with its number of words in pos.
    voted = grams.join(F.broadcast(positions), ["k", "code"], "left").where("k = 0 or template is not null")
    votes = (
        voted.repartition("rid")
        .groupBy("rid", "template", (F.col("pos") - F.coalesce("tpos", F.lit(0))).alias("diagonal"))
        .agg(F.first("doc_id").alias("doc_id"), F.first("pos").alias("pos"), F.collect_set("tpos").alias("found"))
    )
    known = votes.join(F.broadcast(facts), "template", "left")
    reaches = F.when(F.col("exact") | F.col("exact").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(NEIGHBOURS).cast("long"), F.expr("words div 2")))
    known = known.select("*", F.explode(reaches).alias("reach"))
    line = Window.partitionBy("rid", "template", "reach").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > F.col("reach")).cast("int")
    runs = known.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(line))
    merged = runs.groupBy("rid", "template", "reach", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("pos").alias("pos"),
        *[F.first(c).alias(c) for c in ("label", "base", "exact", "words", "grams", "size")],
        F.min(F.col("diagonal") + F.array_min("found")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("found") + F.col("size")).alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("votes"),
    )
    cover = F.col("votes") / F.col("grams")
    verified = F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise((cover >= MIN_COVER) & (F.col("stop") - F.col("start") <= MAX_STRETCH * F.col("words")))
    spans = merged.select("*", cover.alias("cover"), F.coalesce(verified, F.lit(False)).alias("ok"))
    base = F.col("ok") & F.col("base")
    whole = spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template").isNull(), F.col("pos"))).alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(F.col("ok"), F.struct("start", "stop", "label", "cover")))).alias("spans"),
    )
    return whole.drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lists = []
    for i, t in enumerate(TEMPLATES):
        words = [w.decode() for w in t.words]
        for j in range(len(words) - t.k + 1):
            lists.append(f"({i}, {t.k}, {j}, '{' '.join(words[j : j + t.k])}')")
    facts = ", ".join(f"({i}, '{t.label}', {t.base}, {t.exact}, {len(t.words)}, {len(t.words) - t.k + 1}, {t.k})" for i, t in enumerate(TEMPLATES))
    grams = " UNION ALL ".join(f"SELECT r, {k} AS k, i - 1 AS pos, array_to_string(ws[i : i + {k - 1}], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w)" for k in sorted({t.k for t in TEMPLATES}))
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p(t, k, tpos, gram) AS (VALUES {", ".join(lists)}),
f(t, label, base, exact, words, grams, size) AS (VALUES {facts}),
g AS ({grams}),
v AS (SELECT r, t, pos - tpos AS d, list(DISTINCT tpos) AS hits FROM g JOIN p USING (k, gram) GROUP BY ALL),
known AS (SELECT v.*, f.* EXCLUDE (t), unnest(CASE WHEN exact THEN [0] ELSE [{NEIGHBOURS}, words // 2] END) AS reach FROM v JOIN f USING (t)),
lagged AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t, reach ORDER BY d) > reach THEN 1 ELSE 0 END AS apart FROM known),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY r, t, reach ORDER BY d) AS run FROM lagged),
m AS (SELECT r, t, reach, run, any_value(label) AS label, any_value(base) AS base, any_value(exact) AS exact, any_value(words) AS words, any_value(grams) AS grams,
  min(d + list_min(hits)) AS start, max(d + list_max(hits) + size) AS stop, len(list_distinct(flatten(list(hits)))) AS votes FROM runs GROUP BY r, t, reach, run),
ok AS (SELECT *, votes / grams AS cover FROM m WHERE CASE WHEN exact THEN votes = grams ELSE votes / grams >= {MIN_COVER} AND stop - start <= {MAX_STRETCH} * words END),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM ok GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN s USING (r)"""


ORACLE = _oracle()
