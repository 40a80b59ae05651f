"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents (the last one: the encoded texts). run() writes
each stage's rows as Parquet into the folder that all executors share and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, exact_dedup, mixing, ngram_join
from eventloom.llm import toxicity as toxic
from eventloom.llm.common import discard, stored, table

#: Classifiers, MinHash and BPE can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. The decision is made where the text is read, so nothing is shuffled."""
    chain, _, _ = toxic.train(docs, table(spark, sf_dir, "labels"), toxic.label_categories())
    return toxic.keep_clean(docs, chain)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the smallest doc_id."""
    rows = _numbered(docs)
    found = exact_dedup.exact_dedup(rows.select(KEY, "text"), KEY)
    kept = _without(rows, found.where(~F.col("kept")).select(f"{KEY}.{ROW}"), docs.columns)
    discard(*found.spent)
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links join one row, that of the smallest doc_id."""
    rows = _numbered(docs)
    found = ngram_join.ngram_classes(rows.select(KEY, "text"), KEY)
    return _without(rows, found.where(F.col("class_id") != F.col(KEY)).select(f"{KEY}.{ROW}"), docs.columns)


#: Number of a row within its stage, and its unique key: in order of doc_id, null last; rows that repeat a doc_id by their texts, then by number.
ROW, KEY = "_row", "_key"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW and KEY, kept as a table: so a decision about a row, whatever its doc_id, finds just that row again."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    return rows.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("digest"), ROW))


def _without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows whose ROW isn't in dropped. A filter parts off the rows that surely stay, so only the others are shuffled."""
    gone = stored(dropped.select(ROW), "dropped")
    return exact_dedup.without(rows.select(*columns, ROW), gone, ROW).select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights: rates are bounded by 1, so no document comes twice."""
    rows = _numbered(docs)
    labelled = mixing.label_domains(docs, table(spark, sf_dir, "labels"))
    mixed, _ = mixing.mix(rows, labelled, max_rate=1.0, keep_col=KEY)
    key = F.col(KEY)
    copies = F.when(key["nameless"], mixing.copies(F.col("rate"), key["digest"])).otherwise(mixing.copies(F.col("rate"), key["doc_id"]))
    return _without(rows, mixed.where(copies < 1).select(f"{KEY}.{ROW}"), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and digests of ids and decoded text of every document."""
    return bpe.bpe_digests(docs, bpe.public_tokenizer(), keep=["lang", "source"])


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("ngram_jaccard_join", near_dedup), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
