"""Scalar functions, with the compat helpers where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import compat
from granary.plans.definition import QuerySet
from granary.sources.tables import Tables

QUERIES = QuerySet()
C = F.col


@QUERIES.add("fn_string", "SELECT p_partkey, lower(p_name) AS a, upper(p_brand) AS b, CAST(length(p_type) AS INTEGER) AS c, substr(p_name, 1, 3) AS d, replace(p_type, 'A', 'a') AS e, trim('  ' || p_name || ' ') AS f, substr(p_name, 0, 2) AS g, substr(p_name, -3, 2) AS h FROM part")
def fn_string(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.lower("p_name").alias("a"), F.upper("p_brand").alias("b"), F.length("p_type").alias("c"), compat.substr(C("p_name"), 1, 3).alias("d"), F.replace("p_type", F.lit("A"), F.lit("a")).alias("e"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("f"), compat.substr(C("p_name"), 0, 2).alias("g"), compat.substr(C("p_name"), -3, 2).alias("h"),
    )


@QUERIES.add("fn_concat", "SELECT p_partkey, p_brand || '/' || p_type AS a, p_brand || nullif(p_type, p_type) AS b FROM part")
def fn_concat(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("a"), F.concat("p_brand", F.nullif("p_type", "p_type")).alias("b"))


@QUERIES.add("fn_math", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 1) AS b, p_size + 1 AS c, p_size * 3 - 2 AS d, p_size % 7 AS e, CAST(p_size // 4 AS BIGINT) AS f, -p_size AS g, p_size / nullif(p_size, p_size) AS h FROM part")
def fn_math(t: Tables) -> DataFrame:
    size = C("p_size")
    return t.part.select(
        "p_partkey", F.abs(size - 25).alias("a"), F.round("p_retailprice", 1).alias("b"), (size + 1).alias("c"), (size * 3 - 2).alias("d"), (size % 7).alias("e"), compat.div_int(size, F.lit(4)).alias("f"), (-size).alias("g"), compat.div_real(size, size - size).alias("h"),
    )


@QUERIES.add("fn_null", "SELECT p_partkey, coalesce(nullif(p_size % 3, 0), -1) AS a, ifnull(nullif(p_size % 3, 0), p_size) AS b, nullif(p_size, 7) AS c FROM part")
def fn_null(t: Tables) -> DataFrame:
    third = F.nullif(C("p_size") % 3, F.lit(0))
    return t.part.select("p_partkey", F.coalesce(third, F.lit(-1)).alias("a"), F.ifnull(third, C("p_size")).alias("b"), F.nullif("p_size", F.lit(7)).alias("c"))


@QUERIES.add("fn_typeof", "SELECT p_partkey, 'integer' AS a, 'text' AS b, 'real' AS c, CASE WHEN p_size % 3 = 0 THEN 'null' ELSE 'integer' END AS d FROM part")
def fn_typeof(t: Tables) -> DataFrame:
    kinds = dict(t.part.dtypes)
    name = lambda c: compat.type_name(C(c), kinds[c])
    return t.part.select("p_partkey", name("p_partkey").alias("a"), name("p_name").alias("b"), name("p_retailprice").alias("c"), compat.type_name(F.nullif(C("p_size") % 3, F.lit(0)), "int").alias("d"))


@QUERIES.add("fn_hex", "SELECT p_partkey, hex(CAST(p_partkey AS VARCHAR)) AS a, hex(p_name) AS b FROM part")
def fn_hex(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", compat.hex_text(C("p_partkey")).alias("a"), compat.hex_text(C("p_name")).alias("b"))


@QUERIES.add("fn_cast", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_size AS VARCHAR) AS b, CAST(coalesce(nullif(regexp_extract(p_size || 'abc', '^[0-9]+'), ''), '0') AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CAST(p_partkey AS DOUBLE) + 0.5 AS e FROM part")
def fn_cast(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", C("p_size").cast("double").alias("a"), C("p_size").cast("string").alias("b"), compat.cast_integer(F.concat(C("p_size").cast("string"), F.lit("abc"))).alias("c"),
        compat.cast_integer(F.lit("none")).alias("d"), compat.cast_real(F.concat(C("p_partkey").cast("string"), F.lit(".5xyz"))).alias("e"),
    )


@QUERIES.add("fn_scalar_minmax", "SELECT p_partkey, least(p_size, 20) AS a, greatest(p_size, p_partkey % 9, 3) AS b, CASE WHEN p_size % 3 = 0 THEN NULL ELSE least(5, p_size % 3) END AS c FROM part")
def fn_scalar_minmax(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", compat.scalar_min(C("p_size"), F.lit(20)).alias("a"), compat.scalar_max(C("p_size").cast("long"), C("p_partkey") % 9, F.lit(3).cast("long")).alias("b"), compat.scalar_min(F.lit(5), F.nullif(C("p_size") % 3, F.lit(0))).alias("c")
    )


@QUERIES.add("fn_json_valid", "SELECT event_id, CAST(json_valid(props) AS INTEGER) AS a, CAST(json_valid('{' || props) AS INTEGER) AS b FROM events")
def fn_json_valid(t: Tables) -> DataFrame:
    return t.events.select("event_id", compat.json_valid(C("props")).alias("a"), compat.json_valid(F.concat(F.lit("{"), C("props"))).alias("b"))


@QUERIES.add("fn_json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def fn_json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@QUERIES.add("fn_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def fn_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", compat.date_text(C("o_orderdate")).alias("d"))


@QUERIES.add("fn_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, strftime(o_orderdate, '%H:%M:%S') AS t, CAST(date_diff('day', TIMESTAMP '1990-01-01', date_trunc('day', o_orderdate)) AS INTEGER) AS days FROM orders")
def fn_date_parts(t: Tables) -> DataFrame:
    day = C("o_orderdate")
    return t.orders.select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.date_format(day, "HH:mm:ss").alias("t"), F.datediff(day, F.lit("1990-01-01").cast("date")).alias("days"))


@QUERIES.add("fn_printf", "SELECT p_partkey, printf('%05d-%s', p_partkey, p_brand) AS a FROM part")
def fn_printf(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.printf(F.lit("%05d-%s"), "p_partkey", "p_brand").alias("a"))


@QUERIES.add(
    "fn_more_string",
    "SELECT p_partkey, CAST(instr(p_name, 'a') AS INTEGER) AS a, ltrim('  ' || p_name) AS b, rtrim(p_name || '  ') AS c, chr(CAST(65 + p_size % 26 AS INTEGER)) AS d, CAST(ascii(p_name) AS INTEGER) AS e, '''' || replace(p_name, '''', '''''') || '''' AS f, p_name GLOB 'P*' AS g, reverse(p_brand) AS h, lpad(p_brand, 12, '.') AS i FROM part",
)
def fn_more_string(t: Tables) -> DataFrame:
    name = C("p_name")
    return t.part.select(
        "p_partkey", F.instr(name, "a").alias("a"), F.ltrim(F.concat(F.lit("  "), name)).alias("b"), F.rtrim(F.concat(name, F.lit("  "))).alias("c"), F.char(65 + C("p_size") % 26).alias("d"), F.ascii(name).alias("e"),
        compat.quote(name).alias("f"), compat.glob(name, "P*").alias("g"), F.reverse("p_brand").alias("h"), F.lpad("p_brand", 12, ".").alias("i"),
    )


@QUERIES.add("fn_more_math", "SELECT p_partkey, CAST(sign(p_size - 25) AS DOUBLE) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(pow(p_size, 2) AS DOUBLE) AS d, round(sqrt(p_size), 6) AS e, round(ln(p_size + 1), 6) AS f, round(exp(p_size / 50.0), 6) AS g FROM part")
def fn_more_math(t: Tables) -> DataFrame:
    size, price = C("p_size"), C("p_retailprice")
    return t.part.select(
        "p_partkey", F.signum(size - 25).alias("a"), F.ceil(price).alias("b"), F.floor(price).alias("c"), F.pow(size, F.lit(2)).alias("d"), F.round(F.sqrt(size), 6).alias("e"), F.round(F.log(size + 1), 6).alias("f"), F.round(F.exp(size / F.lit(50.0)), 6).alias("g"),
    )


@QUERIES.add("ext_array", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm, CAST(list_max(embedding) AS DOUBLE) AS high FROM embeddings")
def ext_array(t: Tables) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(squares, 4).alias("norm"), F.array_max("embedding").cast("double").alias("high"))
