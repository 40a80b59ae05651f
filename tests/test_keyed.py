"""Keyed dedup asks each key once a batch, takes a limited source as one batch, and leaves late rows out."""

from pyspark.sql import functions as F

from eventloom.streaming import keyed

SHAPE = "seq long, url_key string, title_key string, hour long"


def test_a_key_is_asked_once_however_many_rows_have_it(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    stream = lambda: spark.readStream.schema("seq long, url_key string, title_key string, arrived timestamp").option("maxFilesPerTrigger", 1).parquet(path("in"))
    seen, late = [], []
    first = [(k, f"u{k % 3}", f" t{k % 2} ", 90) for k in range(400)] + [(400, " ", None, 91), (401, None, "", None), (402, "u8", None, 1)]
    then = [(500, "u8", None, 90), (501, "u9", None, 90), (502, "u5", "t0", 95), (503, "u5", None, 10), (504, "u5", "t7", 95), (505, None, None, 15)]
    for rows in (first, then):
        df = spark.createDataFrame(rows, SHAPE).select("seq", "url_key", "title_key", F.timestamp_seconds(F.col("hour") * 3600 + 1_700_000_000).alias("arrived"))
        df.repartition(2).write.mode("append").parquet(path("in"))  # two files: a limited source has two batches of them
        query = keyed.dedup_run(spark, stream(), path("out"), path("work"), "72 hours")
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert sorted(r.seq for r in spark.read.parquet(path("out/*")).collect()) == [0, 1, 400, 401, 402, 500, 501, 504]  # u8 was forgotten (402 came 90 hours before), t0 was not; 503 and 505 are late
    assert sorted(r.seq for r in spark.read.parquet(path("work/late/*")).collect()) == [503, 505]
    assert seen[0] <= 14 and seen[1] <= 18  # keys of both files, a row for each file, and news; 400 rows have these keys
