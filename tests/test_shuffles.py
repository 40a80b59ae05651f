"""What clustering and the queries on it shuffle: rows once for both sides of a pair, and no column that nobody reads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import facts as ft
from eventloom.functions import text as t
from eventloom.operators import cluster
from eventloom.plans import events
from eventloom.sources.shared import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def told(spark, dated):
    """Four rows for each of fifty events: two of one company nearly at the window's end, one later, one of another company; some without a time or a company."""
    start, out = datetime(2026, 7, 20), []
    for k in range(50):
        for n, (company, hours) in enumerate((("Alpha", 0), ("Alpha", 72), ("Alpha", 72.1), ("Beta", 1))):
            at = None if not dated and (k + n) % 7 == 0 else start + timedelta(hours=hours + k)
            out.append((k * 10 + n, None if k % 11 == 5 and n == 3 else company, f"{company} acquires unit with Gamma Corp for ${k // 2} million on 2026-07-21", "", "", at, f"https://x.example/{k}/{n}"))
    rows = ft.with_facts(spark.createDataFrame(out, "id long, company string, title string, description string, text string, published_at timestamp, url string"))
    return cluster.in_order(rows).cache()


@pytest.mark.parametrize("dated", [True, False])
@pytest.mark.parametrize("some", [True, False])
def test_pairs_of_each_kind_of_rows(spark, dated, some):
    rows = told(spark, dated)
    fresh = (F.col("id") % 3 == 0) if some else None
    ids = lambda met: sorted((x.a, x.b) for x in cluster.decided(met, F.col("company")).where("decision = 'SAME_EVENT'").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect())
    row = lambda n: rows.select(F.col("company").alias(f"{n}_company"), F.struct("ord", "id", "published_at", "title_key", "facts").alias(n))
    every = row("l").join(row("r"), F.col("l_company") == F.col("r_company")).where("l.ord < r.ord").withColumnRenamed("l_company", "company")
    if some:
        every = every.where("l.id % 3 = 0 OR r.id % 3 = 0")
    want = ids(every)
    assert want and ids(cluster.likely_pairs(rows, ["company"], fresh=fresh)) == want == ids(cluster.pairs(rows, ["company"], fresh=fresh))


def test_pairs_take_rows_from_one_shuffle(spark):
    """Both sides of the meeting, and both rows of a pair, come from one shuffle; the rows carry no fact that no rule reads."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = cluster.likely_pairs(stored(told(spark, True), "told"), ["company"])
        met.collect()
        final = plan(met).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("ReusedExchange") == 2
    assert not {"numbers", "actions", "secondary"} & set(met.schema["l"].dataType["facts"].dataType.names)


def test_scored_before_grouped(spark, sf, monkeypatch):
    """Headlines are scored before they meet their groups, and what is read of them isn't kept as a second table with all its columns."""
    kept, keep = [], events.stored
    monkeypatch.setattr(events, "stored", lambda df, name: kept.append(name) or keep(df, name))
    p = events.Q["op_i15_event_coverage"][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert kept == ["facts"] and "Join" in p
    assert "facts#" not in p[: p.index("Join")]


def test_a_host_is_worked_out_seldom(spark):
    """The class of a source mentions its host's patterns a few times, not once for each marker; the markers count where they did."""
    cases = {
        ("https://www.sec.gov/x", ""): "source_of_record", ("https://a.example/newsroom/1", ""): "source_of_record", ("https://ir.example.com", None): "source_of_record", ("https://NEWS.Google.com/x", None): "aggregator_or_low_information",
        ("https://a.example/yahoo", "x"): "direct_publisher", ("https://a.example/x", "Yahoo! Finance"): "aggregator_or_low_information", ("https://newsagoogle.example/x", "msnxcom"): "direct_publisher", (None, "feedburner"): "aggregator_or_low_information",
        (None, None): "unknown_publisher", ("no url", "x"): "unknown_publisher", ("https://user@[::1]:8/x", ""): "direct_publisher",
    }
    df = spark.createDataFrame(list(cases), "url string, source string").select("url", "source", t.source_class(F.col("url"), F.col("source")).alias("got"))
    assert {(r.url, r.source): r.got for r in df.collect()} == cases
    wide = spark.range(1).select(t.source_class(F.concat(F.lit("u"), "id"), F.concat(F.lit("s"), "id")))
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 60
