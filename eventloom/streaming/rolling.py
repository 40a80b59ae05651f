"""Event clusters of a sliding window, maintained batch by batch.

The state is a versioned table of the window's members (with component and group) and of their SAME links. A batch joins its new rows with the members, so old pairs are never compared again. Only components that a new row
joins, or that lost a member to the watermark, are settled again; all others are carried over as they are. So the groups equal those of clustering the whole window anew. An event keeps its id as long as one of its members stays:
a group that is settled again takes the id of its first member that had one, unless an earlier group took it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import cluster
from eventloom.operators.graph import components
from eventloom.sources.shared import discard, stored
from eventloom.streaming.state import Versions

ROW = ("id", "company", "published_at", "url", "title_key", "facts")


def rolling_clusters(state: str, out: str, keep_hours: int = 72, hours: int = cluster.WINDOW_HOURS, verdicts: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for batches of (id, company, published_at, url, title_key, facts).

    Members are what was published within keep_hours of the newest row so far (undated rows: of the newest row when they came). Writes out/batch=<id>: (event_id, id, status) of every row that was settled again (`open`), whose time was
    over (`expired`) or that came after its time (`late`). An id that is a member already is skipped; a batch that was committed is skipped whole."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, state)
        if batch_id in versions.committed():
            return
        rows = batch.select(*ROW).dropDuplicates(["id"])
        kind, shape = rows.schema["id"].dataType, rows.schema.fields
        member = T.StructType([*shape, T.StructField("until", T.TimestampType()), T.StructField("label", kind), T.StructField("group", kind), T.StructField("event_id", T.StringType())])
        link = T.StructType([T.StructField("l", kind), T.StructField("r", kind)])
        last = versions.before(batch_id)
        old, links = versions.read(last, "members", member), versions.read(last, "links", link)
        fresh = stored(rows.join(old.select("id"), "id", "left_anti"), "rolling-new")
        newest = fresh.agg(F.max("published_at").alias("t")).unionByName(old.agg(F.max(F.col("until") - F.make_dt_interval(hours=F.lit(keep_hours))).alias("t"))).agg(F.max("t")).first()[0]
        until = F.coalesce("published_at", F.lit(newest).cast("timestamp")) + F.make_dt_interval(hours=F.lit(keep_hours))
        new = fresh.withColumn("until", until)
        over = F.coalesce(F.col("until") < F.lit(newest).cast("timestamp"), F.lit(False))
        live, gone, late, came = old.where(~over), old.where(over), new.where(over), new.where(~over)

        both = cluster.in_order(live.select(*ROW, F.lit(False).alias("fresh")).unionByName(came.select(*ROW, F.lit(True).alias("fresh"))))
        added = cluster.same_pairs(both, ["company"], F.col("company"), hours, verdicts, F.col("fresh"))
        touched = live.join(added.select(F.col("l").alias("id")).unionByName(added.select(F.col("r").alias("id"))).distinct(), "id").select("label").unionByName(gone.select("label")).distinct()
        touched = stored(touched, "rolling-touched")
        again = live.join(touched, "label", "left_semi")
        open_rows = stored(both.join(again.select("id").unionByName(came.select("id")), "id", "left_semi").join(again.select("id", F.col("event_id").alias("had")), "id", "left"), "rolling-open")
        kept = links.join(live.select(F.col("id").alias("l")), "l", "left_semi").join(live.select(F.col("id").alias("r")), "r", "left_semi").select("l", "r")
        every = stored(kept.unionByName(added.select("l", "r")), "rolling-links")
        inside = every.join(open_rows.select(F.col("id").alias("l")), "l", "left_semi").select("l", "r")
        labels = components(inside.select(F.col("l").alias("a"), F.col("r").alias("b")))
        groups = stored(cluster.greedy_groups(open_rows, inside, labels=labels), "rolling-groups")
        named = _named(open_rows.join(groups, "id")).join(labels.withColumnRenamed("label", "_label"), "id", "left").withColumn("label", F.coalesce("_label", "id"))
        named = named.join(came.select("id", F.col("until").alias("_new")).unionByName(again.select("id", F.col("until").alias("_new"))), "id").withColumn("until", F.col("_new"))
        settled = stored(named.select(*member.names), "rolling-settled")

        versions.write(batch_id, "members", live.join(touched, "label", "left_anti").select(*member.names).unionByName(settled))
        versions.write(batch_id, "links", every)
        told = settled.select("event_id", "id", F.lit("open").alias("status")).unionByName(gone.select("event_id", "id", F.lit("expired").alias("status"))).unionByName(late.select(F.lit(None).cast("string").alias("event_id"), "id", F.lit("late").alias("status")))
        told.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        versions.commit(batch_id)
        discard(fresh, added, touched, open_rows, every, groups, settled, labels)

    return handle


def _named(rows: DataFrame) -> DataFrame:
    """rows(id, ord, group, had) with event_id: the id that the group's first member with one had, if no earlier group has that; else one of its first row."""
    heads = rows.groupBy("group").agg(F.min_by("had", F.struct(F.col("had").isNull().alias("none"), "ord")).alias("had"), F.min("ord").alias("ord"))
    first = F.row_number().over(Window.partitionBy("had").orderBy("ord")) == 1  # groups of one former event
    named = heads.withColumn("event_id", F.when(F.col("had").isNotNull() & first, F.col("had")).otherwise(F.concat(F.lit("event-"), F.col("group").cast("string"))))
    # a split event's later groups are named by their first rows; the event that bore such a name may live on under it, so a repeated name gets a number
    repeat = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("event_id").eqNullSafe(F.col("had")).cast("int").desc(), "ord"))
    named = named.withColumn("event_id", F.when(repeat == 1, F.col("event_id")).otherwise(F.concat("event_id", F.lit("."), repeat.cast("string"))))
    return rows.join(named.select("group", "event_id"), "group")


def members(spark, state: str, schema) -> DataFrame:
    """The window's members by the last committed version; schema of the batches."""
    versions = Versions(spark, state)
    kind = schema["id"].dataType
    shape = T.StructType([schema[c] for c in ROW] + [T.StructField("until", T.TimestampType()), T.StructField("label", kind), T.StructField("group", kind), T.StructField("event_id", T.StringType())])
    return versions.read(max(versions.committed(), default=None), "members", shape)
