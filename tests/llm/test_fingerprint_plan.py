"""The minima of windows are compiled: they aren't merged into the lambda over them, which isn't."""

from eventloom.llm import fingerprint


def test_minima_stay_out_of_the_lambda(spark):
    rows = spark.createDataFrame([(1, 0, "x" * 190, 128)], "doc_id long, place long, piece string, n_windows int")
    plan = fingerprint.with_prints(rows)._jdf.queryExecution().optimizedPlan().toString()
    lambdas = [line for line in plan.splitlines() if "lambdafunction(" in line]
    assert lambdas and not any("array_distinct(" in line for line in lambdas)
