"""Every registered query against its SQL, and a few at several partition counts."""

from __future__ import annotations

import pytest

from granary.plans import registry
from tests.conftest import DATA
from tests.helpers import assert_same, multiset

DEFINITIONS = registry.definitions()


@pytest.mark.parametrize("key", [k for k, q in DEFINITIONS.items() if q.oracle])
def test_query_matches_sql(spark, duck, key):
    query = DEFINITIONS[key]
    assert_same(query.run(spark, str(DATA / "sf0.01")), duck.sql(query.oracle))


@pytest.mark.parametrize("key", ["group_null_key", "agg_multi_distinct", "limit_no_order", "topk_duplicate_rows", "setop_mixed", "intersect_all", "win_rows_frame", "cdc_replay", "route_linear"])
def test_same_answer_at_every_partition_count(spark, key):
    query, found = DEFINITIONS[key], []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 4, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            table = query.run(spark, str(DATA / "sf0.001")).toArrow()
            found.append(multiset(table, sorted(table.column_names)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(f == found[0] for f in found)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
