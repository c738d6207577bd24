"""Quality rules by distribution divergence. DataFrame functions only; no shuffle of texts.

A document's character-class histogram and its common-word histogram are
compared with those of its language by Jensen-Shannon distance (base 2, 0 to
1). Every character is in one of CLASSES, by its Unicode category. The
references are pooled over the documents that pass the base rules: one
aggregation with map-side combination, a row for each language of COMMON_WORDS
and one for all documents. A language that isn't listed, or has too few words
for a reference, is compared by classes alone, and by coarser ones that don't
depend on its script, with the reference of all documents. Punctuated or
capitalised forms don't count as the common word, in a document and in its
reference alike. Guards: texts below a length aren't judged by a histogram.

Base rules come first: too few words, or too much of the text inside repeated
five-word windows.

Defined results: a null or empty text has no words and fails the base rules; a
null language is one that isn't listed; a text of any length is judged whole,
in its row; there are no ties; repeated rows are judged alike; an empty table
gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import KEY_NAMES, checkpointed, keep_rows, row_key, split_words, table, text_or_empty, without_whitespace

# Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "are", "with", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "du", "qui", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "para"],
}
CLASSES = ["upper", "lower", "letter", "digit", "punct", "symbol", "space", "other"]
#: Most characters of a text; what is left without them is sorted into classes.
PLAIN = r"[a-z\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Unicode categories of the first six classes; symbols count SYMBOLS too, which are none of the others' then.
CATEGORIES = [r"[\p{Lu}\p{Lt}]+", r"\p{Ll}+", r"[\p{Lo}\p{Lm}\p{M}]+", r"\p{Nd}+", r"\p{P}+", r"\p{S}+"]
#: Classes that are added up where scripts must not matter: letters and space.
COARSE = [[0, 1, 2, 6], [3], [4], [5], [7]]
N_COMMON = max(map(len, COMMON_WORDS.values()))
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts below these lengths have histograms too coarse to judge.
MIN_CHARS_CLASSES = 300
MIN_WORDS_COMMON = 100
#: A language needs as many words for a reference.
MIN_REFERENCE_WORDS = 2000
MAX_CLASS_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.25
REPORT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def _long(value: Column) -> Column:
    return value.cast("long")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)


def tokenised(docs: DataFrame, text_col: str, lang_col: str, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns, __text, __lang and __words."""
    return docs.select(*keep, text_or_empty(docs[text_col]).alias("__text"), docs[lang_col].alias("__lang"), split_words(docs[text_col]).alias("__words"))


def with_histograms(rows: DataFrame) -> DataFrame:
    """Adds __n_words, __chars, __space, __symbol, __class (counts of CLASSES) and __common (counts of the language's words, all others last)."""
    text = F.col("__text")
    languages = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    step = rows.select(
        "*",
        _long(F.size("__words")).alias("__n_words"),
        _long(F.length(text)).alias("__chars"),
        _long(F.octet_length(text) - F.octet_length(without_whitespace(text))).alias("__space"),
        F.regexp_replace(text, PLAIN, "").alias("__rest"),
        languages[F.col("__lang")].alias("__list"),
    )
    step = step.select("*", F.regexp_replace("__rest", SYMBOLS, "").alias("__sorted"))
    # Lambdas keep these projections out of one generated method, which would grow too large for the JVM to compile.
    found = F.transform("__list", lambda w: _long(F.size("__words") - F.size(F.array_remove("__words", w))))
    counts = F.transform(F.array(*map(F.lit, CATEGORIES)), lambda p: _long(F.length("__sorted") - F.length(F.regexp_replace("__sorted", p, F.lit("")))))
    step = step.select("*", counts.alias("__counts"), _long(F.length("__rest") - F.length("__sorted")).alias("__symbol"), found.alias("__w"))
    upper, lower, letter, digit, punct, symbol = (F.get("__counts", F.lit(i)) for i in range(6))
    plain = F.col("__chars") - F.col("__space") - _long(F.length("__rest"))
    other = _long(F.length("__sorted")) - _total(F.col("__counts"))
    step = step.select("*", F.array(upper, lower + plain, letter, digit, punct, symbol + F.col("__symbol"), F.col("__space"), other).alias("__class"))
    common = F.concat("__w", F.array(F.col("__n_words") - _total(F.col("__w"))))
    return step.select("*", common.alias("__common")).drop("__w", "__list", "__counts", "__rest", "__sorted")


def references_from(rows: DataFrame) -> dict[str | None, tuple[list[float], list[float]]]:
    """Shares of classes and common words of each language of COMMON_WORDS with enough words, and of coarse classes of all documents under None, from rows that pass the base rules. Sums of integers, so reruns agree."""
    columns = [*[f"c{i}" for i in range(len(CLASSES))], *[f"w{i}" for i in range(N_COMMON + 1)]]
    sums = [F.sum(F.get(f"__{'class' if c[0] == 'c' else 'common'}", F.lit(int(c[1:])))).alias(c) for c in columns]
    listed = F.when(F.col("__lang").isin(*COMMON_WORDS), F.col("__lang")).alias("lang")
    pooled = rows.where("not base_failed").groupBy(listed).agg(*sums, F.sum("__n_words").alias("n")).collect()
    found = {r["lang"]: tuple(_as_shares([r[c] or 0 for c in columns if c[0] == kind]) for kind in "cw") for r in pooled if r["lang"] is not None and r["n"] >= MIN_REFERENCE_WORDS}
    if sum(r["n"] for r in pooled) >= MIN_REFERENCE_WORDS:
        found[None] = (_as_shares([sum(r[f"c{i}"] for r in pooled for i in own) for own in COARSE]), [])
    return found


def _as_shares(counts: list[int]) -> list[float]:
    return [x / max(1, sum(counts)) for x in counts]


def _shares(counts: Column) -> Column:
    total = F.greatest(_total(counts), F.lit(1).cast("long"))
    return F.transform(counts, lambda x: x.cast("double") / total.cast("double"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2, rounded to 9 places."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.round(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))), 9)


def _window_hashes() -> Column:
    """A hash of each five-word window of __words; null where none can repeat."""
    n = F.size("__words")
    return F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])))


def _starts_of_equal(pairs: str) -> Column:
    """Sorted s of those sorted (g, s) pairs whose g occurs twice or more."""
    at = lambda j: F.get(pairs, j)["g"]
    again = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: (at(j) == at(j - 1)).eqNullSafe(True) | (at(j) == at(j + 1)).eqNullSafe(True))
    return F.when(F.size(pairs) > 1, F.sort_array(F.transform(again, lambda j: F.get(pairs, j)["s"])))


def _covered_words() -> Column:
    """Words under windows at the sorted __starts: each covers up to the next start, five at most."""
    n = F.size("__starts")
    following = F.concat(F.slice("__starts", F.lit(2), n), F.array(F.element_at("__starts", -1) + WINDOW))
    steps = F.zip_with("__starts", following, lambda a, b: _long(F.least(b - a, F.lit(WINDOW))))
    return F.when(n > 0, _total(steps)).otherwise(F.lit(0).cast("long"))


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds the base columns to rows with histograms; drops __words and __text.

    Equal windows have equal hashes, so a text whose hashes all differ needs
    no more. For the others the hashes are sorted, and the windows that share
    a hash are compared as words.
    """
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = rows.select("*", _window_hashes().alias("__hashes"), lines.alias("__lines"))
    hashed = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("g"), i.alias("s"))))
    step = step.select("*", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), hashed).alias("__pairs")).drop("__hashes")
    step = step.select("*", F.when(F.col("__pairs").isNotNull(), _starts_of_equal("__pairs")).alias("__maybe")).drop("__pairs")
    windows = F.sort_array(F.transform("__maybe", lambda i: F.struct(F.array_join(F.slice("__words", i + 1, WINDOW), " ").alias("g"), i.alias("s"))))
    step = step.select("*", F.when(F.col("__maybe").isNotNull(), windows).alias("__pairs")).drop("__maybe", "__words")
    step = step.select("*", F.when(F.col("__pairs").isNotNull(), _starts_of_equal("__pairs")).alias("__starts")).drop("__pairs")
    step = step.select(
        "*",
        F.col("__n_words").alias("n_words"),
        (F.col("__chars") - F.col("__space")).alias("word_chars"),
        F.col("__symbol").alias("n_symbols"),
        _long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _covered_words().alias("n_repeat_words"),
    ).drop("__lines", "__starts", "__text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.select("*", failed.alias("base_failed"))


def with_verdict(rows: DataFrame, references: dict[str | None, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds class_distance and word_distance (null where a guard holds) and kept to rows that have base and histogram columns. The references, a few numbers, are literals."""

    def of_language(kind: int) -> Column:
        known = {k: v[kind] for k, v in references.items() if k is not None}
        return F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("__lang")] if known else F.lit(None).cast("array<double>")

    step = rows.select("*", of_language(0).alias("__ref_class"), of_language(1).alias("__ref_common"))
    classes = js_distance(_shares(F.col("__class")), F.col("__ref_class"))
    if None in references:
        coarse = F.array(*[sum((F.get("__class", F.lit(i)) for i in own), F.lit(0).cast("long")) for own in COARSE])
        classes = F.when(F.col("__ref_class").isNotNull(), classes).otherwise(js_distance(_shares(coarse), F.array(*map(F.lit, references[None][0]))))
    judged = step.select(
        "*",
        F.when(F.col("__chars") >= MIN_CHARS_CLASSES, classes).alias("class_distance"),
        F.when((F.col("__n_words") >= MIN_WORDS_COMMON) & F.col("__ref_common").isNotNull(), js_distance(_shares(F.col("__common")), F.col("__ref_common"))).alias("word_distance"),
    )
    diverges = (F.col("class_distance") > MAX_CLASS_DISTANCE).eqNullSafe(True) | (F.col("word_distance") > MAX_WORD_DISTANCE).eqNullSafe(True)
    return judged.select("*", (~F.col("base_failed") & ~diverges).alias("kept"))


def judged(docs: DataFrame, keep: list[Column], text_col: str, lang_col: str) -> DataFrame:
    """The ``keep`` columns and REPORT of each row. One pass over the texts: their counts, far smaller, are checkpointed and serve references and verdict."""
    rows = checkpointed(base_counts(with_histograms(tokenised(docs, text_col, lang_col, keep))))
    return with_verdict(rows, references_from(rows))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id and REPORT, a row for each document."""
    return judged(docs, [docs[id_col].alias("doc_id")], text_col, lang_col).select("doc_id", *REPORT)


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns. Texts are judged once; then rows are settled where they are read."""
    keys = row_key(docs[text_col], docs[id_col], docs[lang_col])
    decided = judged(docs, keys, text_col, lang_col).select(*KEY_NAMES, F.col("kept").alias("__kept"))
    return keep_rows(docs, decided, id_col, text_col, [lang_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    lists = " UNION ALL ".join(f"SELECT '{k}' AS lang, {i} AS i, '{w}' AS w" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    categories = ", ".join(f"length(x) - length(regexp_replace(x, '{p}', '', 'g')) AS k{i}" for i, p in enumerate(CATEGORIES))
    term = f"({part.format(x='p', y='q')} + {part.format(x='q', y='p')}) / 2"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM t)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n_repeat FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s0 AS (SELECT r, regexp_replace(text, '{PLAIN}', '', 'g') AS rest FROM t),
s1 AS (SELECT r, rest, regexp_replace(rest, '{SYMBOLS}', '', 'g') AS x FROM s0),
b AS (SELECT t.r, doc_id, lang, len(ws) AS n_words, length(text) AS chars, length(rest) - length(x) AS n_symbols, length(x) AS n_sorted, length(rest) AS n_rest,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, {categories}
  FROM t JOIN s1 USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  [k0, k1 + word_chars - n_rest, k2, k3, k4, k5 + n_symbols, chars - word_chars, n_sorted - k0 - k1 - k2 - k3 - k4 - k5] AS cs FROM b),
cls AS (SELECT r, lang, base_failed, unnest(range(0, 8)) AS i, unnest(cs) AS n FROM f),
lists AS ({lists}),
hits AS (SELECT t.r, lists.i, count(*) AS n FROM (SELECT r, lang, unnest(ws) AS w FROM t) t JOIN lists ON t.lang = lists.lang AND t.w = lists.w GROUP BY ALL),
com0 AS (SELECT f.r, f.lang, f.base_failed, f.n_words, lists.i, coalesce(hits.n, 0) AS n FROM f JOIN lists ON f.lang = lists.lang LEFT JOIN hits ON hits.r = f.r AND hits.i = lists.i),
com AS (SELECT r, lang, base_failed, i, n FROM com0 UNION ALL SELECT r, lang, base_failed, {N_COMMON}, n_words - CAST(sum(n) AS BIGINT) FROM com0 GROUP BY r, lang, base_failed, n_words),
big AS (SELECT lang FROM f WHERE NOT base_failed AND lang IN (SELECT lang FROM lists) GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}),
coarse AS (SELECT r, base_failed, unnest(range(0, 5)) AS i, unnest([cs[1] + cs[2] + cs[3] + cs[7], cs[4], cs[5], cs[6], cs[8]]) AS n, lang FROM f),
hist AS (SELECT 'c' AS kind, lang AS ref, * FROM cls WHERE lang IN (SELECT lang FROM big) UNION ALL SELECT 'w', lang, * FROM com WHERE lang IN (SELECT lang FROM big) UNION ALL SELECT 'o', '', r, lang, base_failed, i, n FROM coarse),
ref AS (SELECT kind, ref, i, sum(n)::DOUBLE / greatest(sum(sum(n)) OVER (PARTITION BY kind, ref), 1)::DOUBLE AS q FROM hist WHERE NOT base_failed GROUP BY kind, ref, i),
own AS (SELECT kind, ref, r, i, n::DOUBLE / greatest(sum(n) OVER (PARTITION BY kind, r), 1)::DOUBLE AS p FROM hist),
js AS (SELECT kind, r, round(sqrt(greatest(sum({term}), 0)), 9) AS dist FROM own JOIN ref USING (kind, ref, i) GROUP BY kind, r),
v AS (SELECT f.*, CASE WHEN chars < {MIN_CHARS_CLASSES} THEN NULL WHEN c.r IS NOT NULL THEN c.dist WHEN (SELECT sum(n_words) FROM f WHERE NOT base_failed) >= {MIN_REFERENCE_WORDS} THEN o.dist END AS class_distance, CASE WHEN n_words >= {MIN_WORDS_COMMON} THEN w.dist END AS word_distance
  FROM f LEFT JOIN (SELECT * FROM js WHERE kind = 'c') c ON c.r = f.r LEFT JOIN (SELECT * FROM js WHERE kind = 'w') w ON w.r = f.r LEFT JOIN (SELECT * FROM js WHERE kind = 'o') o ON o.r = f.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > {MAX_CLASS_DISTANCE}, false) AND NOT coalesce(word_distance > {MAX_WORD_DISTANCE}, false) AS kept, class_distance, word_distance
FROM v"""


ORACLE = _oracle()
