"""Freshness windows and exposure validity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delivery_window(now: datetime, last_success: datetime | None, overlap_hours: int = 2, first_run_hours: int = 30) -> tuple[datetime, datetime]:
    """Literals for the plan, so that Parquet filters push down."""
    if now.tzinfo is None or (last_success is not None and last_success.tzinfo is None):
        raise ValueError("times need a zone")
    return (last_success - timedelta(hours=overlap_hours) if last_success else now - timedelta(hours=first_run_hours)), now


def lookback_window(now: datetime, days: int) -> tuple[datetime, datetime]:
    """D2."""
    if days < 1:
        raise ValueError("days must be at least 1")
    return now - timedelta(days=days), now


def freshness(ts: Column, start, end) -> Column:
    """D3: closed interval; the four classes exclude each other."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(ts.isNull(), "missing").when(ts > end, "future").when(ts < start, "too_old").otherwise("accepted")


def lookback_days(start: datetime | Column, end: datetime | Column, maximum: int) -> int | Column:
    """Date partitions to scan: a superset of the exact filter. Of two times, or of two timestamp columns."""
    if isinstance(start, Column):
        return F.least(F.greatest(F.ceil((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000), F.lit(1)), F.lit(maximum)).cast("long")
    return min(max(-((start - end) // timedelta(days=1)), 1), maximum)


def exposed(articles: DataFrame, exposure_terms: DataFrame) -> DataFrame:
    """articles(seq, query_key, published_at) left join exposure_terms(query_key, company, exposure_id, valid_from, families), each row with `rejection`
    (null: a candidate). The term table joins by key; whether it is broadcast is left to its measured size."""
    met = articles.join(exposure_terms, "query_key", "left")
    reason = (
        F.when(F.coalesce("query_key", F.lit("")) == "", "missing_query").when(F.col("exposure_id").isNull(), "unregistered_query")
        .when(F.col("published_at").isNull(), "missing_timestamp").when(F.to_date("published_at") < F.col("valid_from"), "before_valid_from")
    )
    return met.withColumn("rejection", reason)
