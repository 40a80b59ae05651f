"""Sharding by Hilbert order: metadata dimensions are quantised, rows sorted by their curve index and cut into runs of equal count.

* Quantisation: the distinct values of each dimension are counted and ranked (whole strings, numbers as they are), and a value's rank gives one of 2^bits bins;
  so bins hold about equal rows, and ties fall into one bin.
* Curve: the Hilbert index of every cell comes from a table of 2^(bits * dimensions) rows that a rule makes; its size is a parameter,
  and it is the only table that is broadcast (beside one row for each partition).
* Order: (index, CRC-32 of the text, id, hash of the text). One range shuffle of narrow rows sorts them; a hot cell is cut like any other, since its rows
  differ in id. Places come from the row numbers within partitions plus the partitions' offsets.
* Cut: the law is `rows`: shard = floor(place * shards / rows), so counts differ by one at most. Groups of equal texts with equal metadata lie side by side, in
  one shard unless a cut falls into them.

Neighbouring shards cover compact boxes of the dimensions, so min/max statistics of files prune on each of them.

Defined results: null dimension values come before all others; null texts have no bytes (size 16, CRC 0). Rows that repeat get neighbouring places. Fewer rows than
shards leave shards empty. Null ids are kept and come first of their texts' place. Equal texts lie side by side only if their dimensions are equal. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import discard, stored, table, whole

SHARDS, BITS = 40, 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a point on the Hilbert curve through the cube of side 2^bits: Gray code walk, one digit of each axis at a time."""
    n, entry, direction, index = len(point), 0, 0, 0
    for level in range(bits - 1, -1, -1):
        corner = sum(((x >> level) & 1) << k for k, x in enumerate(point))
        turned = _rotate_right(corner ^ entry, direction + 1, n)
        digit, shift = turned, 1
        while shift < n:
            digit ^= digit >> shift
            shift <<= 1
        index = index << n | digit
        start = 0 if digit == 0 else _gray(2 * ((digit - 1) // 2))
        turn = 0 if digit == 0 else _trailing_ones(digit - 1) % n if digit % 2 == 0 else _trailing_ones(digit) % n
        entry ^= _rotate_left(start, direction + 1, n)
        direction = (direction + turn + 1) % n
    return index


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    count = 0
    while i & 1:
        i, count = i >> 1, count + 1
    return count


def _rotate_right(x: int, by: int, n: int) -> int:
    by %= n
    return (x >> by | x << (n - by)) & ((1 << n) - 1)


def _rotate_left(x: int, by: int, n: int) -> int:
    return _rotate_right(x, n - by % n, n)


def cut_points(rows: DataFrame, dim: str, bits: int) -> list[tuple[object, int]]:
    """(smallest value, bin) of the bins above 0 that a value opens: a value's bin is floor(2^bits * rows below it / rows), by its rank among the counted distinct values, whole
    strings included. One range shuffle of (value, count); at most 2^bits - 1 values reach the driver."""
    counts = rows.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = stored(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "shard-values")
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))  # one row for each partition of the range shuffle
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    total = placed.agg(F.sum("n")).first()[0] or 1
    below = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n")
    binned = placed.join(F.broadcast(before), "part").withColumn("bin", F.floor(below * F.lit(1 << bits) / F.lit(total)).cast("int"))
    found = [(r.value, r.bin) for r in binned.groupBy("bin").agg(F.min("value").alias("value")).where("bin > 0").collect()]
    discard(placed)
    return sorted(found, key=lambda x: x[1])


def quantised(rows: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """rows with bin_0, bin_1, ..., 0 to 2^bits - 1 (null: 0)."""
    for k, dim in enumerate(dims):
        number = F.lit(0)
        for value, n in cut_points(rows, dim, bits):
            number = F.when(F.col(dim) >= F.lit(value), F.lit(n)).otherwise(number)
        rows = rows.withColumn(f"bin_{k}", number)
    return rows


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """(bin_0, ..., curve_index): 2^(dims * bits) rows."""
    side = range(1 << bits)
    cells = [()]
    for _ in range(dims):
        cells = [(*c, x) for c in cells for x in side]
    return spark.createDataFrame([(*c, hilbert_index(c, bits)) for c in cells], ", ".join(f"bin_{k} int" for k in range(dims)) + ", curve_index int")


def hilbert_shards(docs: DataFrame, dims: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(id_col, size, text_crc32, curve_index, dims..., shard, slot) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(whole(text_col)) + 16).cast("long").alias("size"), F.crc32(F.encode(whole(text_col), "UTF-8")).alias("text_crc32"), F.xxhash64(whole(text_col)).alias("tie"), *(c.alias(f"dim_{k}") for k, c in enumerate(dims.values())))
    names = [f"dim_{k}" for k in range(len(dims))]
    binned = quantised(stored(rows, "shard-rows"), names, bits)
    bins = [f"bin_{k}" for k in range(len(dims))]
    placed = binned.join(F.broadcast(curve(docs.sparkSession, len(dims), bits)), bins)
    order = ["curve_index", "text_crc32", "id", "tie"]
    dealt = placed.select("id", "size", "text_crc32", "tie", "curve_index", *names).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "shard-order").withColumn("part", F.shiftright("at", 33))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition of the range shuffle
    before = sizes.select("part", F.sum("n").over(Window.orderBy("part")).alias("upto"), "n").select("part", (F.col("upto") - F.col("n")).alias("before"))
    total = dealt.count()
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = dealt.join(F.broadcast(before), "part").withColumn("place", place).withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * bigint({total}) + {shards - 1}) div {shards}")
    return found.select(F.col("id").alias(id_col), "size", "text_crc32", "curve_index", *(F.col(n).alias(d) for n, d in zip(names, dims, strict=True)), "shard", (F.col("place") - first).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"lang": F.col("lang"), "source": F.col("source"), "text_bytes": F.octet_length(whole("text"))}
    found = hilbert_shards(table(spark, sf_dir, "documents"), dims)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index", "lang", "source")
