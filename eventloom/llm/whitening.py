"""Embedding whitening by a weighted multiplicity covariance.

Entries become integers x = floor(scale * entry) + offset, so that equal vectors are equal to the last bit. Rows are grouped by their x vector; a distinct vector enters the fit with weight one, or with
its number of rows (`counted`). Weighted sums are exact integers; the covariance is a sum of centred matrix products, one of each partition, and Spark adds up their entries. The driver gets sums of d by d
numbers (d: the dimension) and decomposes them. Each distinct vector is whitened once and joined back to its rows; a vector that many rows share is broadcast to them (`attach`).

Defined results: rows whose vector is null or holds null or non-finite entries have no result. Entries are clipped to +-2^52 after scaling. Vectors of each length are a space of their own, fitted apart; an
empty vector has no component, so no row. Components are at most the dimension; one whose eigenvalue is zero to double precision (as with a single distinct vector) has null `whitened`. `deviation` is null
where it exceeds a long. Null and repeated ids keep their rows. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import attach, mapped, stored, table

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Scaled entries beyond this are clipped, so that integers and doubles of them are the same.
CLIP = 1 << 52
_LOW = 26  # integers are added in two parts of bits, so that no partition's sum overflows


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    scaled = lambda c: F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(float(-CLIP))), F.lit(float(CLIP)))
    return F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(offset).cast("long"))


def sound(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Batches of (x, weight) -> rows (pos, high, low) of the partition; pos d has the sum of weights."""
    high, low, seen = np.zeros(d + 1, np.int64), np.zeros(d + 1, np.int64), False
    for batch in batches:
        x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy()
        seen = seen or len(x) > 0
        high[:d] += w @ (x >> _LOW)
        low[:d] += w @ (x & ((1 << _LOW) - 1))
        low[d] += w.sum()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(high), pa.array(low)], ["pos", "high", "low"])


def weighted_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(sum of weights, exact weighted sum of each dimension) of fit(x, weight)."""
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    parts = mapped(fit, lambda it: _sums(it, d), "pos int, high long, low long").groupBy("pos").agg(total("high"), total("low")).collect()  # d + 1 rows
    sums = {r.pos: (int(r.high) << _LOW) + int(r.low) for r in parts}
    return sums.get(d, 0), [sums.get(k, 0) for k in range(d)]


class Centre:
    """The mean S/n, as whole part and rest, so that x - S/n loses no digit."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        rest = np.array([s % self.n for s in self.sums], kind)
        found = ((off.astype(kind) * self.n - rest) ** 2).sum(axis=1)
        return [int(v) if int(v) < 1 << 63 else None for v in found]


def _upper(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])


def _products(batches: Iterator[pa.RecordBatch], d: int, centre: Centre | None) -> Iterator[pa.RecordBatch]:
    """Batches of (vector, weight) -> upper triangle of the partition's sum of weighted outer products."""
    total, seen = np.zeros((d, d)), False
    for batch in batches:
        x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy()
        x = centre.centred(x) if centre else x
        total += x.T @ (w[:, None] * x)
        seen = seen or len(x) > 0
    if seen:
        yield _upper(total)


def second_moments(fit: DataFrame, d: int, centre: Centre | None = None) -> np.ndarray:
    """Sum of the weighted outer products of fit(vector, weight), centred before multiplying: d by d numbers."""
    out = np.zeros((d, d))
    for r in mapped(fit, lambda it: _products(it, d, centre), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the first `most` components; eigenvalues that are zero to double precision are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most].copy(), vectors[:, ::-1][:, :most]
    values[values <= len(covariance) * np.finfo(float).eps * max(values.max(initial=0), 0)] = 0
    return values, vectors


def _whitened(batches: Iterator[pa.RecordBatch], d: int, centre: Centre, projection: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(2), d)
        z = centre.centred(x) @ projection
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centre.deviations(x), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["key", "rows", "deviation", "z"])


def _space(named: DataFrame, distinct: DataFrame, d: int, total: int, components: int, counted: bool) -> DataFrame:
    """Results of the rows (id, key) whose vectors have length d."""
    fit = distinct.where(F.size("x") == d).select("key", "rows", "x", (F.col("rows") if counted else F.lit(1).cast("long")).alias("weight"))
    n, sums = weighted_sums(fit.select("x", "weight"), d)
    centre = Centre(n, sums)
    covariance = second_moments(fit.select("x", "weight"), d, centre) / n
    values, vectors = principal(covariance, min(components, d))
    usable = int((values > 0).sum())
    projection = vectors[:, :usable] / np.sqrt(values[:usable])
    white = stored(mapped(fit.select("key", "rows", "x"), lambda it: _whitened(it, d, centre, projection), "key string, rows long, deviation long, z array<double>"), "whitened")
    error = 0.0
    if usable:
        weights = white.select("z", (F.col("rows") if counted else F.lit(1).cast("long")).alias("weight"))
        error = float(np.abs(second_moments(weights, usable) / n - np.eye(usable)).max())
    trace = float(np.trace(covariance))
    shares = [float(v / trace) if trace > 0 else 0.0 for v in values]
    met = attach(named, white, "key", "rows", total)
    each = met.select("id", "deviation", "z", F.posexplode(F.array(*map(F.lit, shares))).alias("at", "explained"))
    return each.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("z", F.col("at")).alias("whitened"), "explained", F.lit(error).alias("identity_error"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, counted: bool = False, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    x = rows.where(sound(F.col(vector_col))).select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale, offset).alias("x")).where(F.size("x") > 0)
    key = F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), 256)
    distinct = stored(x.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).select(key.alias("key"), "rows", "x"), "distinct-vectors")
    lengths = {r.d: r.n for r in distinct.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("n")).collect()}  # a row for each length of vector
    total = sum(lengths.values())
    parts = [_space(x.where(F.size("x") == d).select("id", key.alias("key")), distinct, d, total, components, counted) for d in sorted(lengths)]
    if not parts:
        parts = [x.select("id", F.lit(0).alias("component"), *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
