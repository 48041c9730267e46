"""Queries without SQL: each runs whole, and those with a plain definition are compared with it."""

import pytest

from tidewave.plans import archive, events, exports, pixels, relations, statistics, traces, waves  # noqa: F401
from tidewave.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert len(out.collect()) > 0 and out.columns


def test_components_over_links_and_copeaking_pairs(spark):
    links = [(r.event_id, r.cause_id) for r in QUERIES["farthest_back_link"](spark, SF).collect()]
    links += [(r.a, r.b) for r in waves._copeak_links(traces.peaks(spark, SF)).collect()]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.event_id: r.component for r in QUERIES["link_components"](spark, SF).collect()} == {x: root(x) for x in parent}


def test_exact_tails_agree_with_the_normal_score(spark):
    rows = QUERIES["mann_whitney_p"](spark, SF).collect()
    assert all(0 <= r.p <= 1 and r.p <= r.holm <= 1 for r in rows)
