"""Article dedup (first wins, not transitive), merged provenance and duplicate groups."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.graph import components
from eventloom.operators.order import numbered
from eventloom.sources.shared import discard, stored


#: Rounds over all open rows before components are looked for, and rows of a component that one task settles in order.
ROUNDS, CHUNK = 4, 100_000
_KEYS = ("url_key", "title_key")


def dedup_map(rows: DataFrame, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """H1: rows(seq, url_key, title_key) -> (seq, primary_seq, reason); reason is null for rows that stay.

    A row is a duplicate if an earlier *retained* row has its url key, else its title key; blank keys never match. So the rows that stay are a greedy matching of url and title keys in order of seq. First come rounds over all open rows:
    each retains the rows that are smallest among the open ones of both their keys, and settles the rows that share a key with them. That ends nearly all rows unless they form long chains. What is left falls into components of
    keys; the first `chunk` open rows of each are settled in order by one task, then the rounds go on with the rest. So a chain takes a round for each `chunk` rows and some for its component, and no task has more than `chunk` rows.

    A round aggregates keys map-side and joins the minima back, so a hot title costs each task one row; its rows are split by the skew join. Each table replaces the one before it, which is deleted."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    every = stored(rows.select("seq", *(blank(k).alias(k) for k in _KEYS)), "dedup-rows")
    left, kept = every, []
    while True:
        for _ in range(rounds):
            left = _settled(every, left, _smallest(left), kept)
            if left is None:
                break
        if left is None:
            break
        left = _settled(every, left, *_first_of_components(left, chunk), kept)
        if left is None:
            break
    stays = stored(reduce(DataFrame.unionByName, kept), "dedup-kept")
    by_url = stays.where(F.col("url_key").isNotNull()).select("url_key", F.col("seq").alias("by_url"))
    by_title = stays.where(F.col("title_key").isNotNull()).select("title_key", F.col("seq").alias("by_title"))
    met = every.join(stays.select("seq", F.lit(True).alias("stays")), "seq", "left").join(by_url, "url_key", "left").join(by_title, "title_key", "left")
    by_url, by_title = (F.when(F.col(c) < F.col("seq"), F.col(c)) for c in ("by_url", "by_title"))
    found = met.select("seq", F.when(F.col("stays"), F.col("seq")).otherwise(F.coalesce(by_url, by_title)).alias("primary_seq"), F.when(F.col("stays"), F.lit(None).cast("string")).when(by_url.isNotNull(), "canonical_url").otherwise("normalized_title").alias("reason"))
    out = stored(found, "dedup-map")
    discard(every, stays, *kept)
    return out


def _smallest(left: DataFrame) -> DataFrame:
    """The open rows that are smallest among those of both their keys."""
    seen = left
    for k in _KEYS:
        seen = seen.join(left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("seq").alias(f"{k}_first")), k, "left")
    return seen.where((F.coalesce("url_key_first", "seq") == F.col("seq")) & (F.coalesce("title_key_first", "seq") == F.col("seq"))).select("seq", *_KEYS)


def _settled(every: DataFrame, left: DataFrame, stays: DataFrame, *more) -> DataFrame | None:
    """The rows of left that are open after `stays` (seq and keys) have been retained; kept, the last argument, takes these. Before it, optionally, all rows (seq) that are settled by it. None if nothing is open."""
    *others, kept = more
    stays = stored(stays, "dedup-stays")
    kept.append(stays)
    now = left.join(stays.select("seq"), "seq", "left_anti")
    for settled in others:
        now = now.join(settled, "seq", "left_anti")
    for k in _KEYS:
        now = now.join(stays.where(F.col(k).isNotNull()).select(k), k, "left_anti")
    now = stored(now.select("seq", *_KEYS), "dedup-left")
    discard(*others, *([left] if left is not every else []))
    if now.limit(1).count() == 0:
        discard(now)
        return None
    return now


def _first_of_components(left: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, all rows) of the first `chunk` open rows of each component of keys, in order."""
    node = lambda k: F.concat(F.lit(f"{k[0]}:"), F.col(k))
    labels = components(left.where(F.col("url_key").isNotNull() & F.col("title_key").isNotNull()).select(node("url_key").alias("a"), node("title_key").alias("b")))
    own = left.withColumn("id", F.coalesce(node("url_key"), node("title_key"))).join(labels, "id", "left").select("seq", *_KEYS, F.coalesce("label", "id").alias("label"))
    placed = numbered(own, ["label", "seq"], "pos", "dedup-places")
    first = placed.groupBy("label").agg(F.min("pos").alias("first"))
    now = stored(placed.join(first, "label").where(F.col("pos") < F.col("first") + chunk).select("label", "seq", *_KEYS), "dedup-chunk")
    kind = left.schema["seq"].dataType.simpleString()
    discard(placed, labels)
    settled = now.select("seq")
    settled.stored_at = now.stored_at
    return now.groupBy("label").applyInPandas(_in_order, f"seq {kind}, url_key string, title_key string"), settled


def _in_order(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of one component that the plain loop retains."""
    taken: set[tuple[int, str]] = set()
    stay = []
    part = part.sort_values("seq")
    for at, keys in enumerate(zip(part["url_key"], part["title_key"], strict=True)):
        own = [(k, v) for k, v in enumerate(keys) if isinstance(v, str)]
        if not any(x in taken for x in own):
            taken.update(own)
            stay.append(at)
    return part.iloc[stay][["seq", *_KEYS]]


def merged_provenance(rows: DataFrame, mapped: DataFrame, lists: list[str]) -> DataFrame:
    """H2: (primary_seq, *lists): the lists of a retained row and its duplicates, distinct in order of seq."""
    met = rows.select("seq", *lists).join(mapped.select("seq", "primary_seq"), "seq")
    out = mapped.select("primary_seq").distinct()
    for c in lists:  # first place of each value, before anything is gathered: a group of any size sends its distinct values only
        values = met.select("primary_seq", "seq", F.posexplode(c).alias("pos", "v")).groupBy("primary_seq", "v").agg(F.min(F.struct("seq", "pos")).alias("first"))
        one = values.groupBy("primary_seq").agg(F.array_sort(F.collect_list(F.struct("first", "v"))).alias("all")).select("primary_seq", F.transform("all", lambda s: s["v"]).alias(c))
        out = out.join(one, "primary_seq", "left").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return out


def duplicate_groups(mapped: DataFrame) -> DataFrame:
    """H3: (primary_seq, duplicates, reason of the first duplicate)."""
    dup = mapped.where("reason IS NOT NULL")
    return dup.groupBy("primary_seq").agg(F.count(F.lit(1)).alias("duplicates"), F.min_by("reason", "seq").alias("reason"))
