"""Sent and run ledgers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.order import numbered
from eventloom.sources.shared import discard, stored


def appended_sent(ledger: DataFrame, batch: DataFrame, keep: int = 5000) -> DataFrame:
    """ledger(kind, fingerprint, seq) after batch(kind, fingerprint, pos): distinct in order, known ones skipped, a blank is an error, the newest `keep` of each kind stay.

    Places within a kind come from one order over all kinds (range shuffle and offsets), so a kind may hold any share of the rows. The result is a stored table."""
    clean = batch.withColumn("fingerprint", F.when(F.coalesce(F.trim("fingerprint"), F.lit("")) == "", F.raise_error(F.lit("blank fingerprint")).cast("string")).otherwise(F.col("fingerprint")))
    fresh = clean.groupBy("kind", "fingerprint").agg(F.min("pos").alias("pos")).join(ledger.select("kind", "fingerprint"), ["kind", "fingerprint"], "left_anti")
    placed = numbered(fresh, ["kind", "pos", "fingerprint"], "n", "ledger-new")
    kinds = placed.groupBy("kind").agg(F.min("n").alias("first")).join(ledger.groupBy("kind").agg(F.max("seq").alias("last")), "kind", "left")
    added = placed.join(kinds, "kind").select("kind", "fingerprint", (F.coalesce("last", F.lit(-1)) + F.col("n") - F.col("first") + 1).alias("seq"))
    both = numbered(ledger.select("kind", "fingerprint", "seq").unionByName(added), ["kind", F.desc("seq")], "n", "ledger-all")
    newest = both.join(both.groupBy("kind").agg(F.min("n").alias("first")), "kind").where(F.col("n") < F.col("first") + keep)
    out = stored(newest.select("kind", "fingerprint", "seq"), "ledger")
    discard(placed, both)
    return out


def appended_runs(ledger: DataFrame, run: DataFrame, keep: int = 50) -> DataFrame:
    """runs(at, mode, status, checkpoint) with the new run; the newest `keep` stay."""
    both = ledger.unionByName(run)
    return both.orderBy(F.desc("at"), F.desc("mode")).limit(keep)


def last_checkpoint(runs: DataFrame) -> DataFrame:
    """The checkpoint of each mode's last success; failures never advance it."""
    return runs.where("status = 'success' AND checkpoint IS NOT NULL").groupBy("mode").agg(F.max_by("checkpoint", "at").alias("checkpoint"), F.max("at").alias("at"))
