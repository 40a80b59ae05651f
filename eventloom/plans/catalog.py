"""All queries of the event operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as t
from eventloom.operators import dedup
from eventloom.plans import articles, decisions, events, scalars
from eventloom.sources import views

ALL = scalars.Q | articles.Q | events.Q | decisions.Q
QUERIES = {name: f for name, (f, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to duplicate-free articles in order: canonical urls and title fingerprints, greedy dedup, newest first."""
    a = views.page_articles(spark, sf_dir)
    keyed = a.withColumn("canonical_url", t.canonical_url(F.col("url"))).withColumn("title_key", t.title_key(F.col("title")))
    kept = dedup.dedup_map(keyed.select("seq", F.lower("canonical_url").alias("url_key"), "title_key")).where("reason IS NULL")
    return keyed.join(kept.select("seq"), "seq", "left_semi").select("seq", "canonical_url", "title", "source", "published_at").orderBy(F.desc("published_at"), "seq")
