"""Mixing sources to target weights by soft membership.

1. A classifier fitted on a bounded sample of the labelled table (smallest hashed ids) predicts each document's domain posteriors from the shares of its bytes.
2. Nonnegative document rates r minimise |A r - t|^2, A[d, i] = tokens_i * posterior_i[d], t the target totals: projected
   gradient descent (with momentum) from r = 1, in the metric of the token counts, so that a long text's rate moves no faster than a short one's.
   An iteration is one aggregation over all documents: the driver sends the list of past gradients (D numbers each), the tasks
   replay them for their documents and return D sums. So no rate vector is kept, and a lost executor costs its tasks only.

Target totals are in proportion to the weights. `scale` sets their sum: by default the largest for which no domain's soft total must grow, so rates need not
pass 1; `max_rate` bounds the rates from above as well.

Tokens are words (runs without white space). Defined results: null counts as empty; a text without tokens has rate 1 and changes no total; an empty table gives
an empty result; a domain that no sample row has gets posterior 0; a document of a domain without a weight is shared out among those that have one. Null ids are kept. Rows that repeat count each. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import SAMPLE_TEXT_BYTES, bounded_sample, labelled_texts, mapped, stored, table, whole
from eventloom.llm.learn import fit_softmax, settled, softmax
from eventloom.llm.texthash import BLANK, slices

SAMPLE_ROWS, ITERATIONS, TOLERANCE = 6000, 60, 1e-4
#: Domains of `labels` and `documents`: bad text is junk in any language, good text belongs to its language. The weights are production parameters.
WEIGHTS = {"en": 0.52, "de": 0.15, "fr": 0.15, "es": 0.15, "junk": 0.03}


def byte_shares(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, square roots of the shares of the 256 bytes, words) of each text, slice by slice."""
    for first, data, starts in slices(texts):
        inside = ~BLANK[data]
        begins = np.concatenate(([0], np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))))
        counts = np.zeros((len(starts) - 1, 256))
        for k, (a, b) in enumerate(zip(starts, starts[1:] - 1, strict=False)):
            counts[k] = np.bincount(data[a:b], minlength=256)
        yield first, np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), begins[starts[1:]] - begins[starts[:-1]]


class Domains:
    """Softmax regression on byte shares."""

    def __init__(self, names: list[str], middle: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.names, self.middle, self.spread, self.weights = names, middle, spread, weights

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return settled(softmax(((x - self.middle) / self.spread) @ self.weights[:-1] + self.weights[-1]))


def _sample_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, x, _ in byte_shares(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), batch.column(1)[first : first + len(x)]], ["x", "domain"])


def train(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_TEXT_BYTES) -> Domains:
    """labelled(id_col, domain): at most sample_rows rows of it are used, with texts of at most sample_bytes."""
    chosen = bounded_sample(labelled.where(F.col("domain").isin(names)), id_col, sample_rows)
    rows = labelled_texts(docs, chosen, id_col, text_col, ["domain"], sample_bytes)
    got = mapped(rows, _sample_shares, "x array<float>, domain string").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(len(got), 256)
    y = np.array([names.index(d) for d in got["domain"].to_pylist()], int)
    order = np.lexsort((*x.T[::16], y))  # rows come in any order: sorted by content, the fit is always the same
    x, y = x[order], y[order]
    middle = x.mean(axis=0) if len(x) else np.zeros(256)
    spread = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(256)
    weights = fit_softmax((x - middle) / spread, y, len(names)) if len(x) else np.zeros((257, len(names)))
    return Domains(names, middle, spread, weights)


def _belonging(batches: Iterator[pa.RecordBatch], domains: Domains) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, x, tokens in byte_shares(batch.column(1)):
            p = domains.posteriors(x)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(p)], pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["id", "n_tokens", "posteriors"])


def replay(p: np.ndarray, steps: list[tuple[np.ndarray, float]], max_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points ahead of them) after the gradient steps so far; p: posteriors, one row a document."""
    rate = ahead = np.ones(len(p))
    for gradient, momentum in steps:
        new = np.clip(ahead - p @ gradient, 0, max_rate)
        ahead = new + momentum * (new - rate)
        rate = new
    return rate, ahead


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit_rates(members: DataFrame, weights: list[float], scale: float | None = None, max_rate: float = float("inf"), iterations: int = ITERATIONS) -> tuple[list, dict]:
    """members(n_tokens, posteriors) -> (gradient steps that replay() turns into rates, {targets, totals, iterations, met: within ten times TOLERANCE of the sum of targets})."""
    d = len(weights)

    def sums(batches):
        for batch in batches:
            tokens, p = np.asarray(batch.column(0)).astype(float), _matrix(batch.column(1))
            if len(tokens):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((tokens @ p, ((p * tokens[:, None]).T @ p).ravel()))], pa.list_(pa.float64()))], ["s"])

    added = lambda df, k: np.array(df.select(*(F.sum(F.col("s")[i]) for i in range(k))).first(), float)
    narrow = members.select("n_tokens", "posteriors")
    first = np.nan_to_num(added(mapped(narrow, sums, "s array<double>"), d + d * d))
    have, gram = first[:d], first[d:].reshape(d, d)
    share = np.array(weights) / sum(weights)
    wanted = share > 0
    total = scale if scale is not None else (float((have[wanted] / share[wanted]).min()) if len(have) else 0.0)
    target, rate = share * total, 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-9)
    steps: list[tuple[np.ndarray, float]] = []
    ahead_totals = totals = before = have
    for k in range(iterations):
        if np.abs(totals - target).max() <= TOLERANCE * max(total, 1) or k > 9 and np.abs(totals - before).max() <= 0.1 * TOLERANCE * max(total, 1):
            break  # met, or as near as the bounds of the rates allow
        steps.append((rate * (ahead_totals - target), k / (k + 3)))

        def rated(batches, done=tuple(steps)):
            for batch in batches:
                tokens, p = np.asarray(batch.column(0)).astype(float), _matrix(batch.column(1))
                if len(tokens):
                    now, ahead = replay(p, done, max_rate)
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(((tokens * now) @ p, (tokens * ahead) @ p))], pa.list_(pa.float64()))], ["s"])

        got = np.nan_to_num(added(mapped(narrow, rated, "s array<double>"), 2 * d))
        before, totals, ahead_totals = totals, got[:d], got[d:]
    met = bool(np.abs(totals - target).max(initial=0) <= 10 * TOLERANCE * max(total, 1))
    return steps, {"targets": target.tolist(), "totals": totals.tolist(), "iterations": len(steps), "met": met}


def label_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the rows that the labelled table knows."""
    known = labels.select("doc_id", "quality").dropna()
    return docs.select("doc_id", "lang").join(known, "doc_id").select("doc_id", F.when(F.col("quality") == 0, F.lit("junk")).otherwise(F.col("lang")).alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", scale: float | None = None, max_rate: float = float("inf"), keep_col: str | None = None) -> tuple[DataFrame, dict]:
    """((id_col or keep_col, n_tokens, posteriors, rate) for every document, report). The expected totals sum(n_tokens * rate * posterior[d]) meet the targets, or come as near
    as the bounds of the rates and the number of iterations let them: the report has {domains, targets, totals, iterations, met}."""
    weights = weights or WEIGHTS
    domains = train(docs, labelled, list(weights), id_col, text_col)
    rows = docs.select(F.col(keep_col or id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    members = stored(mapped(rows, lambda it: _belonging(it, domains), f"id {kind}, n_tokens long, posteriors array<double>"), "mixing-members")
    steps, report = fit_rates(members, list(weights.values()), scale, max_rate)

    def final(batches):
        for batch in batches:
            if batch.num_rows:
                rate = np.where(np.asarray(batch.column(1)) > 0, replay(_matrix(batch.column(2)), steps, max_rate)[0], 1.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["id", "n_tokens", "posteriors", "rate"])

    rated = mapped(members, final, f"id {kind}, n_tokens long, posteriors array<double>, rate double").select(F.col("id").alias(keep_col or id_col), "n_tokens", "posteriors", "rate")
    return rated, {"domains": list(weights)} | report


def copies(rate: Column, key: Column, seed: int = 20) -> Column:
    """Whole number of copies whose expectation is the rate: its floor, and one more for a share of the keys (by hash)."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed, report = mix(docs, label_domains(docs, table(spark, sf_dir, "labels")))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    of = lambda name: F.element_at(F.array(*map(F.lit, report[name])), best)
    return mixed.select("doc_id", "n_tokens", F.element_at(F.array(*map(F.lit, WEIGHTS)), best).alias("likeliest"), F.array_max("posteriors").alias("likelihood"), "rate", of("targets").alias("domain_target"), of("totals").alias("domain_total"), copies(F.col("rate"), F.col("doc_id")).alias("copies"))
