"""Ranking, caps, suppression, digests, samples and log trimming."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.graph import components
from eventloom.operators.order import numbered
from eventloom.sources.shared import discard, stored

#: Order of (route, materiality).
PRIORITY = {"direct|high": 0, "external|high": 1, "direct|medium": 2, "direct|low": 3, "external|medium": 4, "external|low": 5}


def priority() -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p)), F.concat_ws("|", "route", "materiality"))


def rank_order() -> list[Column]:
    """J1; the item id makes the order total."""
    return [F.col("priority"), F.desc_nulls_last("published_at"), F.lower("company"), F.lower("title"), F.col("item_id")]


def ordered(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items in order; with a limit, by a top-k of each partition."""
    out = items.withColumn("priority", priority()).orderBy(*rank_order())
    return out.limit(limit) if limit else out


def ranked(items: DataFrame) -> DataFrame:
    """items with their place: a range shuffle, row numbers within partitions, and partition offsets (no single task sees all rows)."""
    dealt = items.withColumn("priority", priority()).repartitionByRange(*rank_order()).sortWithinPartitions(*rank_order())
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def capped(items: DataFrame, per_company: int, total: int | None = None) -> DataFrame:
    """J2, one company an item: at most per_company items of each company, then at most total."""
    kept = items.withColumn("priority", priority()).withColumn("in_company", F.row_number().over(Window.partitionBy("company").orderBy(*rank_order()))).where(F.col("in_company") <= per_company)
    return kept.orderBy(*rank_order()).limit(total) if total else kept


#: Items of a component that one task settles in order.
CHUNK = 100_000


def capped_shared(items: DataFrame, cap: int, total: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """J2, several companies an item: items(item_id, rank, companies) that fit every company's cap when taken in order of rank; of these the first `total`.

    Companies that share items form components. In a round, one task takes the first `chunk` open items of each component in order; then all items of a company that is full are rejected at once, wherever they are. So a round
    settles at least `chunk` items of every component, and a hot company's items are gone with the round that fills it: there are about cap * companies / chunk rounds. An item without a company always fits.

    Whether an item fits hangs on earlier ones only. So with a `total` of up to `chunk` components aren't needed: a round settles the first open items of all in one task, and ends with `total` of them taken."""
    left = stored(items.select("item_id", "rank", F.array_distinct(F.filter(F.coalesce("companies", F.array().cast("array<string>")), lambda c: c.isNotNull())).alias("companies")), "caps-left")
    free = left.where(F.size("companies") == 0).select("item_id")
    kept, used, first = [stored(free, "caps-kept")], None, left
    left = stored(left.where(F.size("companies") > 0), "caps-left")
    discard(first)
    few = bool(total) and total <= chunk
    size, found = min(chunk, max(50 * (total or 0), 1000)), 0
    while left.limit(1).count():
        steps = ()
        if few:
            place = F.row_number().over(Window.partitionBy("label").orderBy("rank", "item_id"))
            now = left.orderBy("rank", "item_id").limit(size).withColumn("label", F.lit(0)).withColumn("pos", place)
        else:
            now, steps = _first_of_components(left, chunk)
        now = stored(now.select("label", "item_id", "pos", "companies"), "caps-chunk")
        each = now.select("label", "item_id", "pos", F.posexplode("companies").alias("i", "company"))
        each = each.join(used, "company", "left").withColumn("n", F.coalesce("n", F.lit(0))) if used is not None else each.withColumn("n", F.lit(0).cast("long"))
        told = each.groupBy("label", "item_id", "pos").agg(F.sort_array(F.collect_list(F.struct("i", "company", "n"))).alias("room"))
        shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, companies array<string>"
        taken = stored(told.groupBy("label").applyInPandas(lambda part: _taken(part, cap), shape), "caps-kept")
        kept.append(taken)
        found += taken.count() if few else 0
        if few and found >= total:
            discard(now)
            break
        size = min(chunk, 8 * size)
        more = taken.select(F.explode("companies").alias("company")).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
        before, used = used, stored(more if used is None else more.unionByName(used).groupBy("company").agg(F.sum("n").alias("n")), "caps-used")
        closed = left.select("item_id", F.explode("companies").alias("company")).join(used.where(F.col("n") >= cap).select("company"), "company", "left_semi").select("item_id")
        last, left = left, stored(left.join(now.select("item_id").unionByName(closed).distinct(), "item_id", "left_anti"), "caps-left")
        discard(last, *steps, now, *([before] if before is not None else []))
    chosen = stored(reduce(DataFrame.unionByName, (k.select("item_id") for k in kept)), "caps-chosen")
    discard(left, *kept, *([used] if used is not None else []))
    out = items.join(chosen, "item_id", "left_semi")
    return out.orderBy("rank").limit(total) if total else out


def _first_of_components(left: DataFrame, chunk: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(the first `chunk` open items of each component, with label and pos; the tables they are read from)."""
    one = F.get("companies", F.lit(0))
    labels = components(left.where(F.size("companies") > 1).select(one.alias("a"), F.explode(F.slice("companies", 2, 1 << 30)).alias("b")))
    own = left.withColumn("id", one).join(labels, "id", "left").select("item_id", "rank", "companies", F.coalesce("label", "id").alias("label"))
    placed = numbered(own, ["label", "rank", "item_id"], "pos", "caps-places")
    begin = placed.groupBy("label").agg(F.min("pos").alias("begin"))
    return placed.join(begin, "label").where(F.col("pos") < F.col("begin") + chunk), (placed, labels)


def _taken(part: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The items of one component that fit, in order; room: each company with the number of items that it has already."""
    used: dict[str, int] = {}
    out = []
    for row in part.sort_values("pos").itertuples():
        for r in row.room:
            used.setdefault(r["company"], r["n"])
        names = [r["company"] for r in row.room]
        if all(used[c] < cap for c in names):
            out.append((row.item_id, names))
            for c in names:
                used[c] += 1
    return pd.DataFrame(out, columns=["item_id", "companies"])


def unsent(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """G4."""
    return items.join(ledger.select("kind", "fingerprint"), ["kind", "fingerprint"], "left_anti")


def first_in_run(items: DataFrame) -> DataFrame:
    """The first of each (kind, fingerprint) in order of rank, with the number of items it stands for."""
    w = Window.partitionBy("kind", "fingerprint")
    return items.withColumn("same_run", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy("rank"))).where("_rn = 1").drop("_rn")


def digest(items: DataFrame) -> DataFrame:
    """Companies by best rank; items inside by newest, then rank."""
    inside = F.array_sort(F.collect_list(F.struct((-F.unix_micros("published_at")).alias("newest"), "rank", "item_id")))
    return items.groupBy("company").agg(F.min("rank").alias("best_rank"), F.transform(inside, lambda s: s["item_id"]).alias("items"))


def round_robin(rows: DataFrame, by: str, order: list[Column], limit: int = 20) -> DataFrame:
    """The n-th of every reason before the (n+1)-th of any, at most limit."""
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return nth.where(F.col("nth") <= limit).orderBy("nth", by).limit(limit)


def newest(rows: DataFrame, by: list[str], order: Column, keep: int) -> DataFrame:
    """J6."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_rn") <= keep).drop("_rn")


def first_k(rows: DataFrame, by: list[str], order: list[Column], k: int, reason: str) -> DataFrame:
    """Rows beyond the k-th of their key get the reason."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("cap_reason", F.when(F.col("_rn") > k, F.lit(reason))).drop("_rn")


def chunked(rows: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows with chunk number in their key."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))
