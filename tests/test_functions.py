"""Compat helpers against SQLite itself, and routing against its fixed values."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from granary.functions import compat
from granary.functions.routing import Linear, Modulo, bucket_column, hash_column, hash_key

ROWS = [(1, 7, 2, "ABCdef", "12abc"), (2, -7, 2, "it's", " -3.5e1x"), (3, 5, 0, "", "none"), (4, None, 3, None, None), (5, 0, -4, "a*b?c", "+9")]
CASES = [
    ("a / b", lambda c: compat.div_int(c("a"), c("b"))),
    ("CAST(a AS REAL) / b", lambda c: compat.div_real(c("a"), c("b"))),
    ("min(a, b)", lambda c: compat.scalar_min(c("a"), c("b"))),
    ("max(a, b, 3)", lambda c: compat.scalar_max(c("a"), c("b"), F.lit(3).cast("long"))),
    ("s LIKE 'abc%'", lambda c: compat.like(c("s"), "abc%").cast("int")),
    ("s GLOB 'A*[d-f]'", lambda c: compat.glob(c("s"), "A*[d-f]").cast("int")),
    ("s GLOB 'a?b*'", lambda c: compat.glob(c("s"), "a?b*").cast("int")),
    ("substr(s, 0, 2)", lambda c: compat.substr(c("s"), 0, 2)),
    ("substr(s, 2)", lambda c: compat.substr(c("s"), 2)),
    ("substr(s, -2)", lambda c: compat.substr(c("s"), -2)),
    ("substr(s, -3, 2)", lambda c: compat.substr(c("s"), -3, 2)),
    ("substr(s, 4, -2)", lambda c: compat.substr(c("s"), 4, -2)),
    ("CASE WHEN a IS NULL THEN NULL ELSE hex(a) END", lambda c: compat.hex_text(c("a"))),
    ("quote(s)", lambda c: compat.quote(c("s"))),
    ("typeof(a)", lambda c: compat.type_name(c("a"), "bigint")),
    ("typeof(s)", lambda c: compat.type_name(c("s"), "string")),
    ("CAST(t AS INTEGER)", lambda c: compat.cast_integer(c("t"))),
    ("CAST(t AS REAL)", lambda c: compat.cast_real(c("t"))),
    ("json_valid(coalesce(t, '[1'))", lambda c: compat.json_valid(F.coalesce(c("t"), F.lit("[1")))),
    ("json_valid('{\"a\": [' || id || ']}')", lambda c: compat.json_valid(F.concat(F.lit('{"a": ['), c("id"), F.lit("]}")))),
    ("round(a / 2.0)", lambda c: compat.round_real(c("a") / F.lit(2.0))),
]


@pytest.mark.parametrize("text,build", CASES, ids=[c[0] for c in CASES])
def test_compat_matches_sqlite(spark, text, build):
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE r (id INTEGER, a INTEGER, b INTEGER, s TEXT, t TEXT)")
    lite.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", ROWS)
    want = [x[0] for x in lite.execute(f"SELECT {text} FROM r ORDER BY id")]
    frame = spark.createDataFrame(ROWS, "id long, a long, b long, s string, t string")
    got = [r[0] for r in frame.orderBy("id").select(build(F.col)).collect()]
    assert got == want


def test_total_of_nothing(spark):
    assert spark.range(3).where("id < 0").agg(compat.total(F.col("id"))).first()[0] == 0.0


def test_hash_goldens():
    assert hash_key("user:1") == 0xF7FD9AAA75081CEB
    assert hash_key("user:2") == 0xF7FD9BAA75081E9E
    assert hash_key("") == 0xCBF29CE484222325
    assert hash_key("user:1") % 64 == 43


def test_columns_hash_as_single_keys_do(spark):
    keys = ["", "user:1", "é" * 300, "x", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(hash_column(F.col("k"), "string")).collect()]
    assert got == [None if k is None else hash_key(k) - (1 << 64) * (hash_key(k) >> 63) for k in keys]
    numbers = [0, -1, 2**62, 7]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "k long").select(bucket_column(F.col("k"), "bigint", Modulo(64))).collect()]
    assert got == [hash_key(n) % 64 for n in numbers]


def test_unroutable_keys(spark):
    with pytest.raises(ValueError):
        hash_key(1.5)
    with pytest.raises(ValueError):
        hash_column(F.lit(1.5), "double")


def test_linear_growth_moves_one_bucket(spark):
    import numpy as np

    hashes = np.array([hash_key(i) for i in range(2000)], np.uint64)
    routing = Linear(3)
    for _ in range(20):
        grown = routing.grown()
        before, after = routing.place(hashes), grown.place(hashes)
        moved = before != after
        assert grown.buckets == routing.buckets + 1
        assert set(before[moved]) == {routing.split} and set(after[moved]) == {routing.buckets}
        routing = grown


def test_like_folds_ascii_only_and_has_no_escape(spark):
    row = spark.sql("SELECT 'É' AS a, 'AbC' AS b, 'a\\\\%c' AS c").select(compat.like(F.col("a"), "é"), compat.like(F.col("b"), "aB_"), compat.like(F.col("c"), "A\\%C"), compat.like(F.col("b"), "a\\%c")).first()
    assert tuple(row) == (False, True, True, False)
