"""Validity of partitions and their fallback, on odd groups, without sorting or holding the rows of a task."""

from eventloom.operators import verdicts


def test_partitions_are_counted_not_sorted(spark):
    ids = {c: [c * 10, c * 10 + 1, c * 10 + 2] for c in range(12)}
    groups = [
        (0, 1, [0, 1], 0, "a"), (0, 2, [2], 2, "b"),  # whole
        (1, 1, [10, 11], 10, "a"),  # an id is missing
        (2, 1, [20, 21, 22], 20, "a"), (2, 2, [22], 22, "b"),  # one twice
        (3, 1, [30, 31, 32, 99], 30, "a"),  # a stranger
        (4, 1, [40, 41, 42], 99, "a"), (5, 1, [50, 51, 52], 50, " "),  # representative, label
        (6, 1, [60, 61, 62], 60, "a"), (6, 2, [], 60, "b"),  # an empty group
        (7, 1, [70, 71, 72, None], 70, "a"), (9, 1, [90, 90, 91, 92], 90, "a"), (10, 1, [100, 101, 102], 100, "a"), (10, 2, None, 100, "b"), (50, 1, [500], 500, "a"),
    ]
    cand = [(c, i, f"title {i}") for c, own in ids.items() for i in own] + [(0, 1, "title 1"), (11, None, "none")]  # a candidate that comes twice, one without id; 8 has no groups
    rows = spark.createDataFrame(cand, "company long, id long, title string")
    told = spark.createDataFrame(groups, "company long, group_no long, members array<long>, representative long, label string")
    valid = verdicts.partition_validity(rows, told)
    assert {r.company: r.valid for r in valid.collect()} == {c: c in (0, 10) for c in ids}
    out = verdicts.with_fallback(rows, told)
    got = sorted(((r.company, r.members, r.label) for r in out.collect()), key=repr)
    assert got == sorted([(c, m, lab) for c, _, m, _, lab in groups if c in (0, 10)] + [(c, [i], t) for c, i, t in cand if c not in (0, 10)], key=repr)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("HashJoin") == 2
