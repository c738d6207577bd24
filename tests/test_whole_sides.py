"""Queries read whole tables: no bounds on ids but where a point or a range of ids is the feature."""

import re

from granary.plans import registry

#: Point reads, and bounds that leave nothing, which is what those queries are about.
MEANT = {"point_lookup", "point_lookup_or", "in_empty", "agg_sum_empty", "agg_wrapped_empty", "subq_scalar_empty", "exists_const", "not_exists_const"}


def test_no_query_reads_an_id_subset():
    ids = r"(o_orderkey|l_orderkey|c_custkey|o_custkey|n_nationkey|r_regionkey|event_id|lsn)"
    bounds = rf"WHERE[^()]*\b{ids}\s*(<|>|<=|>=|=|BETWEEN)\s*\d+"
    found = {k for k, sql in registry.oracle_sql().items() if re.search(bounds, sql)}
    assert found <= MEANT, found - MEANT
