"""Whole texts go to Python in small batches."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.plans import scalars
from eventloom.sources import shared


@pytest.mark.parametrize("query", [scalars.op_b2_query_key, scalars.op_c4_publisher_links])
def test_batches_of_whole_texts_are_bounded(spark, sf, query):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    query(spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == shared.BATCH_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == shared.BATCH_BYTES

    @F.pandas_udf("long")
    def batch_rows(s: pd.Series) -> pd.Series:
        return pd.Series([len(s)] * len(s))

    assert spark.range(0, 1200, 1, 1).select(batch_rows("id").alias("n")).agg(F.max("n")).first()[0] <= shared.BATCH_ROWS
