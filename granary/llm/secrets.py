"""Secret scans over a trigram inverted index. DataFrame functions only.

1. Each rule's regex gives a Boolean trigram query; see trigrams.py.
2. Index: one pass posts, for each document, those trigrams that some query
   uses. Both the trigrams and the clauses follow the rules, not the data.
3. Postings are intersected clause by clause (a bit for each trigram, combined
   map-side), which leaves candidate documents for each rule.
4. Candidates are verified by the rule's regex on their whole texts. A filter of
   fixed size over the candidates tells where a text is read whether it may be
   one; only those that may be are shuffled to their rules. A rule whose query
   has no trigram scans every text where it is read.

Spans are found natively: the texts between matches and the matches
themselves give the matches' places by running sums of their lengths.

Defined results: a null text counts as empty; ids may repeat or be null (rows
alike in id and text share candidates, each row has its result); a text of any
length is scanned whole, in its row; spans that start at one place stand in the
rules' order; an empty table gives an empty result; other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import KEY_NAMES, checkpointed, hash_filter, row_key, table, text_or_empty, with_hit
from granary.llm.trigrams import ALWAYS, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed values. The run patterns of access and hex take runs of the least length or more, which is what dropping shorter ones leaves.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
]
BLOCK = 128


def candidates(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame:
    """row_key() and the indexes of the indexed rules (an array) of each document that some clause fits."""
    clauses = [(i, c) for i, r in enumerate(rules) for c in trigram_query(r.pattern) if trigram_query(r.pattern) != ALWAYS]
    grams = sorted({g for _, c in clauses for g in c})
    place = {g: i for i, g in enumerate(grams)}
    spark = docs.sparkSession
    lines = [(place[g], k, i, 1 << b, (1 << len(c)) - 1) for k, (i, c) in enumerate(clauses) for b, g in enumerate(sorted(c))]
    terms = spark.createDataFrame(lines, "gram int, clause int, rule int, bit long, whole long")
    folded = docs.select(*row_key(docs[text_col], docs[id_col]), F.lower(text_or_empty(text_col)).alias("__low"))
    found = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(g)), F.lit(i)) for g, i in place.items()]))
    postings = folded.select(*KEY_NAMES, F.explode(found).alias("gram"))
    hits = postings.join(F.broadcast(terms), "gram").groupBy(*KEY_NAMES, "clause", "rule", "whole").agg(F.bit_or("bit").alias("bits"))
    return hits.where("bits = whole").groupBy(*KEY_NAMES).agg(F.collect_set("rule").alias("__rules"))


def _lengths(text: Column, rule: Rule) -> Column:
    """For each stretch before a match: its length, the match's and the checked group's; the stretch after the last match comes last, with nulls."""
    found = [F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))]
    return F.arrays_zip(*[F.transform(a, lambda x: F.length(x)) for a in found])


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x["0"] + F.coalesce(x["1"], F.lit(0)))


def _block_starts(name: str) -> Column:
    """Running sums before each block of BLOCK stretches, so that a match sums only within its block."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(name) / BLOCK).cast("int")), lambda k: _sum(F.slice(name, k * BLOCK + 1, BLOCK)))
    first = F.array(F.lit(0).cast("long"))
    return F.aggregate(blocks, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _spans(name: str, starts: str, rule: Rule, order: int) -> Column:
    """(start, order, end, kind) of each match that passes."""

    def span(i: Column) -> Column:
        own, block = F.get(name, i), F.floor(i / BLOCK).cast("int")
        start = F.get(starts, block) + _sum(F.slice(name, block * BLOCK + 1, i % BLOCK)) + own["0"]
        return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + own["1"]).alias("end"), F.lit(rule.kind).alias("kind"), own["2"].alias("checked"))

    every = F.transform(F.sequence(F.lit(0), F.size(name) - 2), span)
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,checked:int>>")
    return F.coalesce(F.when(F.size(name) > 1, F.filter(every, lambda s: s["checked"] >= rule.least)), none)


def with_spans(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES)) -> DataFrame:
    """The ``keep`` columns and, for each rule, spans_<kind>: an array of (start, order, end, kind, checked) in code points."""
    full = {i for i, r in enumerate(rules) if trigram_query(r.pattern) == ALWAYS}
    keyed = docs.select(*[docs[c] for c in keep], text_or_empty(docs[text_col]).alias("__text"), *row_key(docs[text_col], docs[id_col]))
    found = checkpointed(candidates(docs, rules, id_col, text_col))
    code = F.xxhash64(*KEY_NAMES)
    tagged = with_hit(keyed, "__hit", code, hash_filter(found.select(code.alias("h"))))
    none = F.lit(None).cast("array<int>").alias("__rules")
    sure = tagged.where("not __hit").select(*keep, "__text", none)
    joined = sure.unionByName(tagged.where("__hit").join(found, KEY_NAMES, "left").select(*keep, "__text", "__rules"))
    due = {i: F.col("__text").rlike(r.pattern) if i in full else F.coalesce(F.array_contains("__rules", i), F.lit(False)) & F.col("__text").rlike(r.pattern) for i, r in enumerate(rules)}
    step = joined.select(*keep, *[F.when(due[i], _lengths(F.col("__text"), r)).alias(f"__l{i}") for i, r in enumerate(rules)])
    step = step.select("*", *[F.when(F.col(f"__l{i}").isNotNull(), _block_starts(f"__l{i}")).alias(f"__b{i}") for i in range(len(rules))])
    return step.select(*keep, *[_spans(f"__l{i}", f"__b{i}", r, i).alias(f"spans_{r.kind}") for i, r in enumerate(rules)])


def _listed(rules: Sequence[Rule]) -> Column:
    """kind:start:end of all spans of the rules, by start, then rule."""
    spans = F.sort_array(F.concat(*[F.col(f"spans_{r.kind}") for r in rules]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), ["doc_id"])
    return found.select(
        "doc_id", *[F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(_listed(BASE_RULES), 256).alias("base_sha256"), _listed([*BASE_RULES, *MORE_RULES]).alias("spans")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate([*BASE_RULES, *MORE_RULES]):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {k} AS ord, '{r.kind}' AS kind, {r.least} AS least, unnest(range(1, len(m) + 1)) AS i, s, m, v FROM (SELECT r, string_split_regex(text, '{p}') AS s, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS v FROM d WHERE regexp_matches(text, '{p}'))"
        )
    base = "ord < 3"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT r, ord, kind, least, length(m[i]) AS ml, length(v[i]) AS vl, sum(length(s[i]) + length(m[i])) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM parts),
spans AS (SELECT r, ord, stop - ml AS start, kind || ':' || (stop - ml) || ':' || stop AS span, kind FROM placed WHERE vl >= least),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, ord) AS spans, string_agg(span, ',' ORDER BY start, ord) FILTER ({base}) AS base FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


ORACLE = _oracle()
