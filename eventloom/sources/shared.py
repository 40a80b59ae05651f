"""Tables kept in the folder that driver and executors share, and the size of batches on their way to Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset (local runs only)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def told_parts(spark: SparkSession) -> int:
    """How many parts rows are dealt out to where adaptive execution, left to itself, would merge them by their bytes to a few."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes of an Arrow batch on its way to Python: texts may be long, and both sides of the pipe hold a batch. A longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches have at most BATCH_ROWS rows and BATCH_BYTES bytes from now on (settings of the session, read when a plan runs)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
