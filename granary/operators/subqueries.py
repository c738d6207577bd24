"""Subqueries, derived tables and common table expressions."""

from __future__ import annotations

from granary.plans.definition import QuerySet

QUERIES = QuerySet()

#: Key, tables, and text that reads the same in Spark and in the oracle, tables in braces.
SHARED = [
    ("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_custkey > (SELECT avg(o_custkey) FROM {orders})"),
    ("subq_scalar_nested", "SELECT count(*) AS n FROM {orders} WHERE o_custkey > (SELECT avg(o_custkey) FROM {orders} WHERE o_orderkey < (SELECT max(o_orderkey) FROM {orders}))"),
    ("subq_scalar_empty", "SELECT count(*) AS n FROM {orders} WHERE o_custkey > (SELECT max(o_custkey) FROM {orders} WHERE o_orderkey < 0)"),
    ("subq_projection", "SELECT n_nationkey, n_nationkey - (SELECT min(n_nationkey) FROM {nation} WHERE n_regionkey = 2) AS apart FROM {nation}"),
    ("subq_in_having", "SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1000 FROM {orders})"),
    ("subq_in_grouped", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey < 5) GROUP BY o_orderstatus"),
    ("exists_const", "SELECT count(*) AS n FROM {orders} WHERE EXISTS (SELECT 1 FROM {region} WHERE r_regionkey > 100)"),
    ("not_exists_const", "SELECT count(*) AS n FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {region} WHERE r_regionkey > 100)"),
    ("derived_table", "SELECT d.c, d.n FROM (SELECT o_custkey AS c, count(*) AS n FROM {orders} GROUP BY o_custkey) d WHERE d.n >= 14"),
    ("derived_nested", "SELECT max(n) AS most FROM (SELECT c, n FROM (SELECT o_custkey AS c, count(*) AS n FROM {orders} GROUP BY o_custkey) a WHERE c % 2 = 0) b"),
    ("ext_correlated_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    ("ext_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c"),
    ("ext_cte", "WITH x AS (SELECT o_custkey AS c, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT max(n) AS m, min(n) AS low FROM x"),
    ("ext_cte_twice", "WITH x AS (SELECT o_custkey AS c, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.c FROM x a JOIN (SELECT max(n) AS m FROM x) b ON a.n = b.m"),
    ("ext_recursive_cte", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT CAST(sum(n) AS BIGINT) AS s, count(*) AS n FROM r"),
]


def _register(key: str, text: str) -> None:
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    QUERIES.add(key, re.sub(r"\{(\w+)\}", r"\1", text))(lambda t: t.sql(text, *names))


for _key, _text in SHARED:
    _register(_key, _text)
