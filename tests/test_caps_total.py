"""Shared caps with a total: the first open items are settled until the total is reached, and give what all items give."""

import random

import pytest

from eventloom.operators import rank


def _greedy(items, cap):
    full, kept = {}, []
    for i, _, cs in items:
        if all(full.get(c, 0) < cap for c in cs):
            kept.append(i)
            for c in cs:
                full[c] = full.get(c, 0) + 1
    return kept


@pytest.mark.parametrize(("seed", "chunk", "total"), [(1, 100_000, 30), (2, 20, 15), (3, 40, 40)])
def test_total_without_components(spark, monkeypatch, seed, chunk, total):
    def unwanted(_):
        raise AssertionError("components of all items aren't needed")

    monkeypatch.setattr(rank, "components", unwanted)
    r = random.Random(seed)
    items = [(k, k, r.sample(["hot", "warm", *"abcdefghijkl"], r.choice((0, 1, 1, 2, 3))) if k % 3 else ["hot"]) for k in range(200)]
    df = spark.createDataFrame(items, "item_id long, rank long, companies array<string>")
    assert [x.item_id for x in rank.capped_shared(df, 3, total, chunk).collect()] == _greedy(items, 3)[:total]
