"""Incremental runs with Structured Streaming: freshness windows from the run ledger, exact dedup over all batches, idempotent delivery."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.dedup import dedup_map
from eventloom.operators.ledger import appended_sent, last_checkpoint
from eventloom.operators.windows import delivery_window, freshness
from eventloom.sources.shared import discard
from eventloom.streaming.state import Versions


def fresh_stream(spark: SparkSession, path: str, schema: str, late: str = "2 hours", ts: str = "published_at", key: str = "canonical_url") -> DataFrame:
    """A file stream with watermark and arrival-order prefilter of repeated keys within it."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All available files as batches, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there before the first batch."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


#: The ledger of runs.
RUN = "mode string, at timestamp, status string, checkpoint timestamp"
CLASSES = ("accepted", "too_old", "future", "missing")


def window_now(spark: SparkSession, ledger: str, mode: str, now: datetime, overlap_hours: int = 2, first_run_hours: int = 30) -> tuple[datetime, datetime]:
    """The window of a run that starts now: from the checkpoint of the mode's last success in the ledger, less the overlap. A failed run has no checkpoint, so it doesn't move the window."""
    last = last_checkpoint(_read(spark, ledger, RUN)).where(F.col("mode") == mode).select(F.unix_micros("checkpoint")).first()
    return delivery_window(now, datetime.fromtimestamp(last[0] / 1e6, UTC) if last else None, overlap_hours, first_run_hours)


def _ran(spark: SparkSession, ledger: str, mode: str, now: datetime, status: str) -> None:
    instant = F.timestamp_micros(F.lit(round(now.timestamp() * 1_000_000)))
    row = spark.range(1).select(F.lit(mode).alias("mode"), instant.alias("at"), F.lit(status).alias("status"), F.when(F.lit(status == "success"), instant).alias("checkpoint"))
    row.write.mode("append").parquet(ledger)


def incremental_run(stream: DataFrame, ledger: str, out: str, checkpoint: str, now: datetime, mode: str = "delivery", ts: str = "published_at", handle: Callable[[DataFrame, int], None] | None = None, overlap_hours: int = 2, first_run_hours: int = 30) -> dict[str, int]:
    """One run over what the stream has now. Each batch's rows are written under their class of freshness, out/batch=<id>/freshness=<class>, so that late rows are kept apart from those that go on; the accepted ones then go to
    `handle`. Rows of each class are counted as they are written (observed), not in a pass of their own. The ledger gets the run with its status: its checkpoint, from which the next window is laid, moves only if everything succeeded.

    Returns the number of rows of each class, and the window's ends (microseconds)."""
    spark = stream.sparkSession
    start, end = window_now(spark, ledger, mode, now, overlap_hours, first_run_hours)
    micros = lambda t: round(t.timestamp() * 1_000_000)
    found = dict.fromkeys(CLASSES, 0) | {"start": micros(start), "end": micros(end)}

    def batches(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        edge = [F.timestamp_micros(F.lit(micros(t))) for t in (start, end)]
        said = batch.withColumn("freshness", freshness(F.col(ts), *edge))
        said = said.observe(seen, *(F.count_if(F.col("freshness") == c).alias(c) for c in CLASSES))
        said.write.mode("overwrite").partitionBy("freshness").parquet(f"{out}/batch={batch_id}")
        for c, n in seen.get.items():
            found[c] += n
        if handle:
            handle(spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}/freshness=accepted") if seen.get["accepted"] else batch.limit(0), batch_id)

    try:
        run_batches(stream, batches, checkpoint).awaitTermination()
    except Exception:
        _ran(spark, ledger, mode, now, "failed")
        raise
    _ran(spark, ledger, mode, now, "success")
    return found


def dedup_batches(out: str, state: str, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """Exact H1 over all batches. The rows that stay are written, and their keys are the state: a row of a later batch whose url or title key an earlier batch retained goes before the
    batch's own H1. Batches come in order and seq grows with them, so this is H1 over all rows. Both writes replace their batch's own folder and the state of other batches alone is read: a repeated batch changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
        rows = batch.select(F.col(seq).alias("seq"), blank("url_key").alias("url_key"), blank("title_key").alias("title_key"))
        known = _read(spark, state, "seq long, url_key string, title_key string, batch long").where(F.col("batch") < batch_id)
        for key in ("url_key", "title_key"):
            rows = rows.join(known.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
        found = dedup_map(rows)
        stay = batch.withColumnRenamed(seq, "seq").join(found.where("reason IS NULL").select("seq"), "seq", "left_semi")
        stay.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        discard(found)
        spark.read.schema(stay.schema).parquet(f"{out}/batch={batch_id}").select("seq", blank("url_key").alias("url_key"), blank("title_key").alias("title_key")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return handle


SENT = "kind string, fingerprint string, seq long"


def mark_sent(path: str, keep: int = 5000) -> Callable[[DataFrame, int], None]:
    """A7 as a versioned table: batch(kind, fingerprint, pos) -> the next version of the ledger. A version counts once its mark is written, last of all: after a crash before that the batch finds the version before it, and a batch that was
    committed changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        versions = Versions(batch.sparkSession, path)
        if batch_id in versions.committed():
            return
        new = appended_sent(versions.read(versions.before(batch_id), "sent", SENT), batch.select("kind", "fingerprint", "pos"), keep)
        versions.write(batch_id, "sent", new)
        versions.commit(batch_id)
        discard(new)

    return handle


def sent(spark: SparkSession, path: str) -> DataFrame:
    """The ledger by its last committed version."""
    versions = Versions(spark, path)
    return versions.read(max(versions.committed(), default=None), "sent", SENT)


def deliver(out: str, ledger: str, kind: str = "event") -> Callable[[DataFrame, int], None]:
    """Writes rows whose fingerprint the ledger lacks, then marks them. Both writes replace their batch's own folder, so a repeated batch changes nothing; a row is
    marked only after it was written."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sent = _read(spark, ledger, "fingerprint string, kind string, batch long").where((F.col("kind") == kind) & (F.col("batch") != batch_id))
        fresh = batch.dropDuplicates(["fingerprint"]).join(sent.select("fingerprint"), "fingerprint", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        spark.read.parquet(f"{out}/batch={batch_id}").select("fingerprint", F.lit(kind).alias("kind")).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return handle
