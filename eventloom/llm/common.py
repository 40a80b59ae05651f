"""Helpers that the corpus operators share: table reading, tables kept in the shared folder, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.shared import discard, shared_dir, small_batches, stored

__all__ = ["BLANKS", "attach", "bounded_sample", "discard", "labelled_texts", "mapped", "shared_dir", "small_batches", "stored", "table", "whole"]

#: Spark's own white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


#: A key with more than one in HOT_SHARE rows is hot; so there are fewer hot keys than that.
HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of table (one row a key; null where there is none). weight: column of table with the number of rows that have the key, of total.

    Hot keys (fewer than HOT_SHARE) are broadcast and their rows dealt out evenly; the other keys are met in a shuffle."""
    others = [c for c in table.columns if c not in (key, weight)]
    side = lambda name, where: table.where(where).select(key, F.struct(*others).alias(name))
    hot = F.col(weight) * HOT_SHARE > total
    met = rows.join(F.broadcast(side("__hot", hot)), key, "left")
    met = met.withColumn("__deal", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(1 << 30)) + 1).cast("int"))
    met = met.join(side("__cold", ~hot).withColumn("__deal", F.lit(0)), [key, "__deal"], "left").withColumn("__met", F.coalesce("__hot", "__cold"))
    return met.select(*(F.col(c) for c in rows.columns), *(F.col(f"__met.{c}").alias(c) for c in others))


def whole(text: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: By default, longer texts are no part of a sample that classifiers are fitted on: so its rows bound what the driver gets. They are scored like all others.
SAMPLE_TEXT_BYTES = 1 << 16


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, labels: list[str], most_bytes: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(text, *labels) of the chosen ids (a bounded sample, one row an id) whose text has at most most_bytes; of an id that repeats in docs, the text of the smallest hash."""
    text = whole(text_col)
    rows = docs.select(id_col, text.alias("text")).where(F.octet_length(text) <= most_bytes).join(F.broadcast(chosen), id_col)
    one = rows.groupBy(id_col, *labels).agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("first"))
    return one.select("first.text", *labels)


def bounded_sample(labelled: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` rows, those whose hashed id is smallest, one an id: the same rows at every run and partitioning."""
    others = [c for c in labelled.columns if c != id_col]
    one = labelled.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*others)).alias("_first")).select(id_col, "_first.*")
    return one.orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(rows)
