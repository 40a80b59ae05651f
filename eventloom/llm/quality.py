"""Quality classifier: a linear-chain conditional random field labels every line good or bad; length-weighted marginals make the document's score.

Features of a line: its looks (shares of byte groups, word length, length), whether the line stood in the text before, and the
same of the lines before and after. The field has two states; it is trained by maximum likelihood on a bounded sample of labelled rows (`sample_rows`, smallest hashed
ids, texts of up to `sample_lines` lines and `sample_bytes`), each line bearing its document's label. A document's quality is the mean of its lines' forward-backward marginals, weighted by length, mapped
to a probability by a logistic curve that is fitted on the same sample.

Defined results: null counts as empty; an empty text is one empty line and is scored as such. Equal texts get equal scores. Null ids are kept.
Extra columns aren't read: labels, languages, sources and ids are no features. An unlabelled sample gives 0.5 for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import SAMPLE_TEXT_BYTES, bounded_sample, labelled_texts, mapped, table, whole
from eventloom.llm.learn import fit_logistic, looks, settled, sigmoid
from eventloom.llm.texthash import _P, mix, slices

SAMPLE_ROWS, ROUNDS, GOOD = 4000, 150, 0.3
#: By default, texts of more lines are no part of the sample.
SAMPLE_LINES = 1000


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length, number of each text's first line and the end)."""
    ends = np.flatnonzero(data == 10)  # every text ends in a line feed
    begin = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(begin, starts)
    own = looks(data, begin, ends)
    power = np.cumprod(np.full(int((ends - begin).max(initial=0)) + 1, _P))
    offset = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[offset])))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashed = mix(total[ends] - total[begin]) ^ mix(text.astype(np.uint64) + np.uint64(77))
    _, at, number = np.unique(hashed, return_index=True, return_inverse=True)
    again = ((at[number] < np.arange(len(hashed))) & (ends > begin)).astype(float)
    own = np.column_stack((own, again, ends == begin))
    head, tail = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[head], after[tail] = 0, 0
    return np.column_stack((own, before, after, head, tail)), (ends - begin).astype(float), first


def lockstep(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(first line of every text, longest texts first; how many of them have a line 0, 1, 2, ...)."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    counts = np.bincount(size, minlength=1)
    alive = (len(size) - np.cumsum(counts))[: int(size.max(initial=0))]
    return first[:-1][order], alive.tolist()


def chain_messages(unary: np.ndarray, first: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds (good : bad) of every line, without its own term. edge[a, b]: weight of state b after state a."""
    starts, alive = lockstep(first)
    sizes = np.diff(first)[np.argsort(-np.diff(first), kind="stable")]
    forth, back = np.zeros(len(unary)), np.zeros(len(unary))
    for t in range(1, len(alive)):
        at = starts[: alive[t]] + t
        x = forth[at - 1] + unary[at - 1]
        forth[at] = np.logaddexp(x + edge[1, 1], edge[0, 1]) - np.logaddexp(x + edge[1, 0], edge[0, 0])
        at = starts[: alive[t]] + sizes[: alive[t]] - 1 - t
        x = back[at + 1] + unary[at + 1]
        back[at] = np.logaddexp(x + edge[1, 1], edge[1, 0]) - np.logaddexp(x + edge[0, 1], edge[0, 0])
    return forth, back


def marginals(unary: np.ndarray, first: np.ndarray, edge: np.ndarray) -> np.ndarray:
    forth, back = chain_messages(unary, first, edge)
    return sigmoid(forth + unary + back)


def pair_marginals(unary: np.ndarray, first: np.ndarray, edge: np.ndarray, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
    """2 x 2 expected counts of neighbouring states."""
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    left, right = forth[at - 1] + unary[at - 1], unary[at] + back[at]
    logs = np.stack([edge[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)])
    e = np.exp(logs - logs.max(axis=0, initial=-1e300))
    return (e / e.sum(axis=0)).sum(axis=1).reshape(2, 2)


class Field:
    """Standardising scales, line weights, state pair weights, and the curve from mean marginal to score."""

    def __init__(self, middle, spread, weights, edge, curve=(1.0, 0.0)):
        self.middle, self.spread, self.weights, self.edge, self.curve = middle, spread, weights, edge, curve

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def raw(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of each text's length-weighted mean marginal (a blank line weighs as one byte)."""
        p, weight = marginals(self.unary(x), first, self.edge), np.maximum(length, 1)
        mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        return settled(sigmoid(self.curve[0] * self.raw(x, length, first) + self.curve[1]))


def fit_field(x: np.ndarray, length: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam steps over the whole sample; the texts weigh alike, whatever their number of lines."""
    field = Field(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    if not len(good) or good.min() == good.max():
        return field
    z = np.column_stack(((x - field.middle) / field.spread, np.ones(len(x))))
    text = np.repeat(np.arange(len(good)), np.diff(first))
    state = good[text]
    w, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    inner = np.ones(len(z), bool)
    inner[first[:-1]] = False
    seen = np.array([[((state[1:] == b) & (state[:-1] == a) & inner[1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
    n = len(z)
    for k in range(1, rounds + 1):
        unary, edge = z @ w[:-4], w[-4:].reshape(2, 2)
        forth, back = chain_messages(unary, first, edge)
        p = sigmoid(forth + unary + back)
        grad = np.concatenate((z.T @ (state - p), (seen - pair_marginals(unary, first, edge, forth, back)).ravel())) / n - l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weights, field.edge = w[:-4], w[-4:].reshape(2, 2)
    curve = fit_logistic(field.raw(x, length, first)[:, None], good.astype(float), l2=1e-3)
    field.curve = (float(curve[0]), float(curve[1]))
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, sample_bytes: int = SAMPLE_TEXT_BYTES) -> Field:
    """Fits the field on at most sample_rows rows of labels(id_col, label) whose texts have at most sample_lines lines and sample_bytes bytes."""
    chosen = bounded_sample(labels.select(id_col, F.col(label).cast("int").alias("good")).dropna(), id_col, sample_rows)
    lines = F.size(F.split("text", "\n"))
    rows = labelled_texts(docs, chosen, id_col, text_col, ["good"], sample_bytes).where(lines <= sample_lines)
    got = mapped(rows, _sample_lines, "good int, length array<double>, features array<double>").toArrow()
    parts = sorted(zip(got["good"].to_pylist(), _arrays(got["length"]), _arrays(got["features"]), strict=True), key=lambda r: (r[0], r[2].tobytes()))
    if not parts:
        return Field(0.0, 1.0, np.zeros(1), np.zeros((2, 2)), (0.0, 0.0))
    first = np.concatenate(([0], np.cumsum([len(p[1]) for p in parts])))
    x = np.concatenate([p[2] for p in parts]).reshape(first[-1], -1)
    return fit_field(x, np.concatenate([p[1] for p in parts]), first, np.array([p[0] for p in parts]))


def _arrays(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists of a column as views of its buffers: no number becomes a Python object on the driver."""
    for chunk in column.chunks:
        values, at = np.asarray(chunk.flatten()), np.concatenate(([0], np.cumsum(np.asarray(chunk.value_lengths()))))
        yield from (values[a:b] for a, b in zip(at, at[1:], strict=False))


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, starts in slices(batch.column(0)):
            x, length, first = line_features(data, starts)
            spans = list(zip(first, first[1:], strict=False))
            yield pa.RecordBatch.from_arrays([batch.column(1)[at : at + len(spans)], pa.array([length[a:b] for a, b in spans], pa.list_(pa.float64())), pa.array([x[a:b].ravel() for a, b in spans], pa.list_(pa.float64()))], ["good", "length", "features"])


def _scored(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, starts in slices(batch.column(1)):
            score = field.score(*line_features(data, starts)) if field.weights.size > 1 else np.full(len(starts) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(score)], pa.array(score)], ["id", "score"])


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every document."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return mapped(rows, lambda it: _scored(it, field), f"id {rows.schema['id'].dataType.simpleString()}, score double").select(F.col("id").alias(id_col), "score")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether the id's row is kept from the fit; a null id has no remainder and counts as not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
