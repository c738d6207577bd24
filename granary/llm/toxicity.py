"""Toxicity by a character n-gram classifier with naive Bayes log-count ratios.

Fit, on labelled rows whose crc32(id) mod HOLD_OUT isn't HELD:
1. A bounded sample: the SAMPLE rows of each label that come first by a
   seeded hash. Ids and labels of that sample alone are broadcast, so texts
   aren't shuffled; its texts are checkpointed.
2. Document counts of hashed n-grams by label, from whole texts, are summed by
   feature; the FEATURES with the largest divergence between labels stay, each
   with its log-count ratio r.
3. A logistic regression with L2 over the present features, each scaled by its
   r, is fitted to the sample on the driver: rows go there as feature numbers of
   two octets, at most 2 * SAMPLE * FEATURES of them (160 MB if every text had
   every feature), and are worked through FIT_ROWS at a time.

Score: one pass over all whole texts with the weights broadcast (one number
for each of 2 ** BITS features).

Labels, lang, source and ids are never inputs of a score. Defined results: a
null text counts as empty and is scored; a null id isn't held out and has no
label; an id labelled twice is toxic if any label says so; without rows of
both labels the score is the share of toxic rows, 0 if there are none; features
of equal divergence rank by their number; a text of any length is counted and
scored whole, by one task; repeated rows score alike; an empty table gives an
empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, table

SIZES = (4, 5, 6)
BITS = 20
SAMPLE = 10_000
FEATURES = 4096
MIN_DOCS = 3
ALPHA = 1.0
L2 = 1e-5
STEPS = 400
#: Rows of the sample whose features are expanded at a time.
FIT_ROWS = 512
SEED = 6
HOLD_OUT, HELD = 4, 2
THRESHOLD = 0.3


def features(text: str | None):
    """Distinct hashed n-grams of a text, lower-cased, whitespace runs as one space, spaces at both ends."""
    import numpy as np

    found = [_hashes(points, n) for points in [_points(text)] for n in SIZES]
    return np.unique(np.concatenate(found))


def _points(text: str | None):
    import numpy as np

    joined = f" {' '.join((text or '').lower().split())} "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hashes(points, n: int):
    """Bucket numbers of all n-grams: a polynomial of the code points, mixed, its top bits."""
    import numpy as np

    m = len(points) - n + 1
    if m < 1:
        return np.empty(0, np.int64)
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + m]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weights of all hashed features, already times their ratios, and the bias."""

    weights: object
    bias: float

    def logit(self, text: str | None) -> float:
        import numpy as np

        points, used = _points(text), []
        for n in SIZES:
            h = _hashes(points, n)
            used.append(h[self.weights[h] != 0])
        return float(self.bias + self.weights[np.unique(np.concatenate(used))].sum(dtype=np.float64))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HOLD_OUT == HELD, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """toxic and text of the bounded sample, checkpointed."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("__toxic"))
    known = known.where(~held_out(id_col)).select(F.col(id_col).alias("__id"), "__toxic", F.xxhash64(id_col, F.lit(SEED)).alias("__order"))
    parts = [known.where(F.col("__toxic") == label).orderBy("__order", "__id").limit(sample) for label in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("__id", "__toxic")
    texts = docs.select(docs[id_col].alias("__doc"), docs[text_col].alias("text"))
    return checkpointed(texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select(F.col("__toxic").alias("toxic"), "text"))


def _counted(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            counts[toxic, features(text.as_py())] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[0, seen])], names=["feature", "pos", "neg"])


def log_ratios(rows: DataFrame, n_pos: int, n_neg: int, n_features: int = FEATURES) -> list:
    """(feature, r) of the features that tell the labels apart best."""
    p, q = (F.col("pos") + ALPHA) / (n_pos + 2 * ALPHA), (F.col("neg") + ALPHA) / (n_neg + 2 * ALPHA)
    counts = rows.mapInArrow(_counted, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rated = counts.where(F.col("pos") + F.col("neg") >= MIN_DOCS).select("feature", F.log(p / q).alias("r"), (F.abs(p - q) * F.abs(F.log(p / q))).alias("gain"))
    return sorted((r["feature"], r["r"]) for r in rated.orderBy(F.desc("gain"), "feature").limit(n_features).collect())


def _present(chosen):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place = np.full(1 << BITS, -1, np.int32)
        place[chosen.value] = np.arange(len(chosen.value), dtype=np.int32)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                at = place[features(text.as_py())]
                found.append(at[at >= 0].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "present"])

    return run


def logistic(rows: list, labels, ratios, steps: int = STEPS, l2: float = L2):
    """Weights and bias by accelerated gradient descent; rows: arrays of feature places. Features are expanded for FIT_ROWS rows at a time."""
    import numpy as np

    y = np.asarray(labels, np.float64)
    lengths = np.array([len(x) for x in rows])
    squares = ratios**2
    # A bound of the loss's curvature: a quarter of the largest squared row norm on average.
    norms = np.array([squares[x].sum() for x in rows]) + 1
    rate = 1 / (0.25 * norms.mean() * 4 + l2)
    w, bias = np.zeros(len(ratios)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    parts = [(i, np.concatenate(rows[i : i + FIT_ROWS]), np.repeat(np.arange(len(lengths[i : i + FIT_ROWS])), lengths[i : i + FIT_ROWS])) for i in range(0, len(rows), FIT_ROWS)] if len(rows) * len(ratios) <= 1 << 22 else None

    def blocks():
        if parts:
            yield from parts
        else:
            for i in range(0, len(rows), FIT_ROWS):
                own = lengths[i : i + FIT_ROWS]
                yield i, np.concatenate(rows[i : i + FIT_ROWS]), np.repeat(np.arange(len(own)), own)

    look_w, look_b, t = w, bias, 1.0
    for _ in range(steps):
        grad, slope, scaled = l2 * look_w, 0.0, ratios * look_w
        for i, columns, row_of in blocks():
            own = y[i : i + FIT_ROWS]
            z = np.bincount(row_of, scaled[columns], len(own)) + look_b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - own) / len(rows)
            grad = grad + ratios * np.bincount(columns, error[row_of], len(ratios))
            slope += error.sum()
        new_w, new_b = look_w - rate * grad, look_b - rate * slope
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look_w, look_b = new_w + (old - 1) / t * (new_w - w), new_b + (old - 1) / t * (new_b - bias)
        w, bias = new_w, new_b
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    import numpy as np

    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    weights = np.zeros(1 << BITS, np.float32)
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return Model(weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rated = log_ratios(rows, n_pos, n_neg, n_features)
    if not rated:
        return Model(weights, float(np.log(n_pos / n_neg)))
    places, ratios = np.array([f for f, _ in rated]), np.array([r for _, r in rated])
    chosen = docs.sparkSession.sparkContext.broadcast(places)
    found = sorted((r["toxic"], bytes(r["present"])) for r in rows.mapInArrow(_present(chosen), "toxic int, present binary").collect())
    w, bias = logistic([np.frombuffer(x, "<u2") for _, x in found], [y for y, _ in found], ratios)
    weights[places] = w * ratios
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import math

        import pyarrow as pa

        for batch in batches:
            logits = [max(-700.0, min(700.0, shared.value.logit(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([1 / (1 + math.exp(-z)) for z in logits], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **names)
    found = score(docs, model, names.get("id_col", "doc_id"), names.get("text_col", "text"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A fitted model; tests measure its held-out accuracy.
ORACLE = None
