"""Every query of the event operators against its SQL, and plans without Cartesian products."""

import pytest

from eventloom.plans import catalog
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    check(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["op_f1_entity_match", "op_g2_exposure_join", "op_h1_article_dedup", "op_g3_same_pairs", "op_g4_unsent", "op_c5_enrichment"])
def test_no_cross_join(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_is_duplicate_free(spark, sf):
    rows = catalog.flagship(spark, sf).collect()
    assert rows and len({r.canonical_url for r in rows}) == len(rows)
    assert [r.published_at for r in rows] == sorted((r.published_at for r in rows), reverse=True)
