"""Pages that share a url: each keeps its own row and its own outcome."""

import duckdb
import pytest

from eventloom.plans import catalog
from tests.oracle import check


@pytest.mark.parametrize("name", ["op_c5_enrichment", "op_c6_enrichment_counters", "op_a1_feed_articles"])
def test_pages_that_share_a_url(spark, sf, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE ('https://x.example.com/' || page_id // 4 AS url) FROM '{sf}/pages.parquet') TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    check(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, str(tmp_path))
