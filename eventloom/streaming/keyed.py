"""N2 with keyed state: exact H1 over a stream, with the retained keys in the state store and forgotten after a time.

Rows are set down first, and each of their keys is asked once a batch, however many rows have it; Python sees keys only. The retained keys of a batch are written to a feedback folder that the next batch reads beside its questions. So a key's
state is looked up and changed only when the key comes, in the state store (RocksDB), and no batch scans what was retained before. Which rows of a batch stay hangs on both of their keys, so H1 itself runs on the batch's rows with unknown
keys, the first of each pair of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.dedup import dedup_map
from eventloom.sources.shared import discard, stored

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "seq long, url_key string, title_key string, arrived timestamp"
#: What a key's events are: a question (`at` is null), or the news that a row with the key stayed, which arrived `at` (milliseconds). The first letter of a key tells its kind: url, title or batch. An answer is a row of the same form.
EVENT = "key string, arrived timestamp, at long"


def _answers(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key: news first, then its question, which is answered if the key is known. The state is the arrival of the row that the key was retained by; it times out when the watermark passes that. A batch's own key is answered with the watermark.

    A call should be cheap, for there is one for each key of a batch: no frame is made or filtered but for a batch's own key."""
    if state.hasTimedOut:
        state.remove()
        return
    asked, news = None, []
    for part in parts:
        at = part["at"].to_numpy(dtype=float, na_value=np.nan)
        open_ = np.isnan(at)
        if not open_.all():
            news.append(at[~open_].max())
        if asked is None and open_.any():
            asked = part.iloc[:1]
    if news:
        state.update((int(max(news)),))
        state.setTimeoutTimestamp(max(int(max(news)), state.getCurrentWatermarkMs() + 1))
    if asked is not None and key[0][0] == "b":
        yield asked.assign(at=state.getCurrentWatermarkMs())
    elif asked is not None and state.exists:
        yield asked


def _keys(rows: DataFrame) -> DataFrame:
    """rows(url_key, title_key, arrived) -> (key, arrived), one row for each key that there is."""
    kinds = F.array(F.concat(F.lit("u"), "url_key"), F.concat(F.lit("t"), "title_key"))
    return rows.select(F.explode(kinds).alias("key"), "arrived").where(F.col("key").isNotNull())


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Deletes path/batch=<id> of batches before this one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(root):
        if int(found.getPath().getName().removeprefix("batch=")) < before:
            fs.delete(found.getPath(), True)


def dedup_run(spark: SparkSession, rows: DataFrame, out: str, work: str, ttl: str = "72 hours") -> StreamingQuery:
    """Takes what the stream rows(seq, url_key, title_key, arrived) has now, all of it as one batch; out/batch=<id> gets the seq of the rows that stay. seq grows with the batches. To be called again for later rows, also after a restart: `work` has
    the checkpoints, the feedback, and the rows of the last batch.

    A row is a duplicate if a retained row has its url key or its title key; a retained key is forgotten when the newest arrival of earlier batches is more than `ttl` later. Rows that come later than that themselves are left out; work/late/batch=<id> names them.

    Two streams run after each other: the first sets the rows down and asks their keys, the second (returned) gets the answers. A batch of the first that comes again sets down the same rows and asks the same again, which changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    feedback, asked, places = (f"{work}/{x}" for x in ("feedback", "asked", "rows"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)

    def ask(batch: DataFrame, batch_id: int) -> None:
        path = f"{places}/batch={batch_id}"
        batch.select(F.col("seq").cast("long"), blank("url_key"), blank("title_key"), "arrived").write.mode("overwrite").parquet(path)
        found = spark.read.schema(ROW).parquet(path)
        keys = _keys(found).groupBy("key").agg(F.max("arrived").alias("arrived"))
        own = found.agg(F.max("arrived").alias("arrived")).select(F.lit(f"b{batch_id}").alias("key"), "arrived")
        keys.unionByName(own).withColumn("at", F.lit(None).cast("long")).write.mode("append").parquet(asked)

    rows.writeStream.foreachBatch(ask).option("checkpointLocation", f"{work}/checkpoint-rows").trigger(availableNow=True).start().awaitTermination()

    for folder in (feedback, asked):  # the folders must be there
        spark.createDataFrame([], EVENT).coalesce(1).write.mode("append").parquet(folder)
    questions, news = (spark.readStream.schema(EVENT).parquet(x) for x in (asked, feedback))
    events = questions.unionByName(news).withWatermark("arrived", ttl)
    answered = events.groupBy("key").applyInPandasWithState(_answers, EVENT, "at long", "append", GroupStateTimeout.EventTimeTimeout)

    def handle(batch: DataFrame, batch_id: int) -> None:
        answers = stored(batch, "keyed-answers")
        told = spark.read.schema(EVENT).parquet(answers.stored_at)  # in the caller's session, whose plans may adapt
        own = told.where("key LIKE 'b%'").select(F.expr("substring(key, 2)").cast("long").alias("batch"), "at").collect()  # a row for each batch of the first stream
        if own:
            found = spark.read.schema(ROW).parquet(*(f"{places}/batch={r.batch}" for r in own))
            late = F.coalesce(F.col("arrived") <= F.timestamp_millis(F.lit(own[0].at)), F.lit(False))
            found.where(late).select("seq").write.mode("overwrite").parquet(f"{work}/late/batch={batch_id}")
            alone = F.when(F.col("url_key").isNull() & F.col("title_key").isNull(), F.col("seq"))
            first = found.where(~late).groupBy("url_key", "title_key", alone.alias("alone")).agg(F.min("seq").alias("seq"), F.min_by("arrived", "seq").alias("arrived"))
            for k in ("url_key", "title_key"):
                known = told.where(F.col("key").startswith(k[0])).select(F.expr("substring(key, 2)").alias(k))
                first = first.join(known, k, "left_anti")
            first = stored(first.select("seq", "url_key", "title_key", "arrived"), "keyed-first")
            mapped = dedup_map(first.select("seq", "url_key", "title_key"))
            kept = first.join(mapped.where("reason IS NULL").select("seq"), "seq", "left_semi")
            kept.select("seq").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            retained = _keys(kept).withColumn("at", F.coalesce(F.unix_millis("arrived"), F.lit(0)))
            retained.write.mode("append").parquet(feedback)  # news of a repeated batch say the same again
            discard(first, mapped)
            _forget(spark, places, min(r.batch for r in own))
        discard(answers)

    return answered.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
