"""Toxicity by a classifier chain: categories are predicted one after the other, each linear model gets the probabilities of the
earlier categories as features, and while training these probabilities are out-of-fold predictions.

The models are fitted on a bounded sample of labelled rows (`sample_rows`, smallest hashed ids; texts of up to `sample_bytes`). Rows of equal content share a fold; a
fold's words, scales and weights are chosen without it. Features: presence of the words (runs of letters,
ASCII capitals as small) that tell the sample's categories best, and shares of byte groups. Scoring reads every whole text once, in numpy.

Defined results: null and empty texts have no words and get the chain's constant terms; where no sample row is labelled, or a category has one value only,
its probability is that of the (smoothed) share. Rows that repeat get equal results. Null ids are kept. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import SAMPLE_TEXT_BYTES, bounded_sample, labelled_texts, mapped, table, whole
from eventloom.llm.learn import fit_logistic, looks, predict_logistic, settled
from eventloom.llm.texthash import mix, slices, word_hashes

SAMPLE_ROWS, WORD_FEATURES, FOLDS = 8000, 160, 5
#: A document at or above this probability of being toxic is rejected.
TOXIC = 0.5
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")


def text_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of each text's first word, looks of the texts)."""
    for first, data, starts in slices(texts):
        hashed, at = word_hashes(data, starts, letters_only=True)
        yield first, hashed, at, looks(data, starts[:-1], starts[1:] - 1)


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, hashed, at, look in text_words(batch.column("text")):
            rows = len(at) - 1
            own = [np.unique(hashed[a:b]).view(np.int64) for a, b in zip(at, at[1:], strict=False)]
            flags = [batch.column(c)[first : first + rows] for c in batch.schema.names[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())), pa.array(list(look), pa.list_(pa.float64())), *flags], ["words", "looks", *batch.schema.names[1:]])


class Chain:
    """The fitted chain: which words count, scales of the looks, and a weight vector for each category in turn."""

    def __init__(self, words: np.ndarray, middle: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]):
        self.words, self.middle, self.spread, self.weights = words, middle, spread, weights
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(words & np.uint64(0xFFFF)).astype(int)] = True

    def features(self, hashed: np.ndarray, at: np.ndarray, look: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at) - 1, len(self.words)))
        if len(self.words) and len(hashed):
            maybe = np.flatnonzero(self.sieve[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.words, hashed[maybe]), len(self.words) - 1)
            hit = self.words[place] == hashed[maybe]
            x[np.searchsorted(at, maybe[hit], side="right") - 1, place[hit]] = 1
        return np.column_stack((x, (look - self.middle) / self.spread))

    def predict(self, x: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(x), 0))
        for w in self.weights:
            seen = np.column_stack((seen, predict_logistic(np.column_stack((x, seen)), w)))
        return settled(seen)


def telling_words(owner: np.ndarray, words: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The `most` words whose presence is furthest from independent of any category (chi-square), among those of five rows or more."""
    known, number = np.unique(words, return_inverse=True)
    n = np.bincount(number, minlength=len(known)).astype(float)
    best = np.zeros(len(known))
    for c in range(y.shape[1]):
        share = y[:, c].mean() if len(y) else 0
        if not 0 < share < 1:
            continue
        k = np.bincount(number, weights=y[owner, c], minlength=len(known))
        best = np.maximum(best, (k - n * share) ** 2 / (n * share * (1 - share)))
    best[n < 5] = 0
    chosen = np.argsort(-best, kind="stable")[:most]
    return np.sort(known[chosen[best[chosen] > 0]])


def content_order(owner: np.ndarray, words: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row when sorted by content, group of each row): rows of equal content share a group, whatever order they come in."""
    mixed = np.zeros(len(look), np.uint64)
    np.add.at(mixed, owner, mix(words))
    key = np.column_stack((mixed.astype(np.float64), look)) if len(look) else np.zeros((0, 1))
    _, group = np.unique(key, axis=0, return_inverse=True)
    place = np.empty(len(look), int)
    place[np.lexsort((np.arange(len(look)), group.ravel()))] = np.arange(len(look))
    return place, group.ravel()


def fit_once(owner: np.ndarray, words: np.ndarray, look: np.ndarray, y: np.ndarray, rows: np.ndarray, most: int) -> Chain:
    """A chain without weights yet: words and scales chosen by the rows in the mask alone."""
    mine = rows[owner]
    numbers = np.cumsum(rows) - 1
    chosen = telling_words(numbers[owner[mine]], words[mine], y[rows], most)
    some = look[rows]
    middle = some.mean(axis=0) if len(some) else np.zeros(look.shape[1])
    spread = np.maximum(some.std(axis=0), 1e-6) if len(some) else np.ones(look.shape[1])
    return Chain(chosen, middle, spread, [])


def fit_chain(owner: np.ndarray, words: np.ndarray, look: np.ndarray, y: np.ndarray, group: np.ndarray | None = None, most: int = WORD_FEATURES, folds: int = FOLDS) -> tuple[Chain, np.ndarray]:
    """(chain, out-of-fold probabilities of the rows). owner, words: a pair for each distinct word of each row; y: rows x categories of 0 and 1; group: rows of one group fall into one fold.

    A fold's probabilities come from models whose words, scales and weights the other folds alone have chosen; where these have no row, the probability is 0.5."""
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(len(y) + 1))
    fold = (np.arange(len(y)) if group is None else group) % folds
    chain = fit_once(owner, words, look, y, np.ones(len(y), bool), most)
    x = chain.features(words[order], at, look)
    parts = []  # (rows of the fold, features of all rows as the other folds see them)
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            parts.append((fold == k, fit_once(owner, words, look, y, fold != k, most).features(words[order], at, look)))
    seen = np.zeros((len(y), 0))
    for c in range(y.shape[1]):
        out = np.full(len(y), 0.5)
        for rows, own in parts:
            with_seen = np.column_stack((own, seen))
            out[rows] = predict_logistic(with_seen[rows], fit_logistic(with_seen[~rows], y[~rows, c]))
        chain.weights.append(fit_logistic(np.column_stack((x, seen)), y[:, c]))
        seen = np.column_stack((seen, out))
    return chain, seen


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_TEXT_BYTES) -> tuple[Chain, np.ndarray, np.ndarray]:
    """Fits a chain on at most sample_rows rows of labels(id_col, ...) whose texts have at most sample_bytes: (chain, out-of-fold probabilities, labels). categories: 0/1 columns over labels, in chain order."""
    flags = labels.select(id_col, *(c.cast("int").alias(f"flag_{k}") for k, c in enumerate(categories.values()))).dropna()
    names = [f"flag_{k}" for k in range(len(categories))]
    rows = labelled_texts(docs, bounded_sample(flags, id_col, sample_rows), id_col, text_col, names, sample_bytes)
    got = mapped(rows, _sample_words, "words array<long>, looks array<double>, " + ", ".join(f"{n} int" for n in names)).toArrow()
    lists = got["words"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    owner = np.repeat(np.arange(len(got)), np.asarray(lists.value_lengths()).astype(int)) if len(got) else np.zeros(0, int)
    words = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64) if len(got) else np.zeros(0, np.uint64)
    width = len(looks(np.zeros(1, np.uint8), np.array([0]), np.array([1]))[0])
    look = np.array(got["looks"].to_pylist(), float).reshape(len(got), width)
    y = np.column_stack([np.asarray(got[n]).astype(float) for n in names])
    place, group = content_order(owner, words, look)  # rows come in any order from the cluster: sorted by content, the fit is always the same
    order = np.argsort(place)
    chain, oof = fit_chain(place[owner], words, look[order], y[order], group[order])
    return chain, oof, y[order]


def _scored(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, hashed, at, look in text_words(batch.column(1)):
            p = chain.predict(chain.features(hashed, at, look))
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(p)], pa.array(list(p), pa.list_(pa.float64()))], ["id", "p"])


def score(docs: DataFrame, chain: Chain, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category>...) for every document."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows, lambda it: _scored(it, chain), f"id {kind}, p array<double>").select(F.col("id").alias(id_col), *(F.col("p")[k].alias(f"p_{n}") for k, n in enumerate(names)))


def _clean(batches: Iterator[pa.RecordBatch], chain: Chain, text_col: str, category: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
        for first, hashed, at, look in text_words(texts):
            p = chain.predict(chain.features(hashed, at, look))[:, category]
            yield batch.slice(first, len(p)).filter(pa.array(p < TOXIC))


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", category: int = CATEGORIES.index("toxic")) -> DataFrame:
    """The rows of docs, all columns, whose probability is below TOXIC."""
    return mapped(docs, lambda it: _clean(it, chain, text_col, category), docs.schema)


def label_categories() -> dict[str, F.Column]:
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return dict(zip(CATEGORIES, (low, toxic, low & toxic), strict=True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_low_quality, p_toxic, p_toxic_low_quality, toxic) for every document; toxic: p_toxic >= TOXIC."""
    chain, _, _ = train(docs, labels, label_categories(), id_col, text_col)
    return score(docs, chain, list(CATEGORIES), id_col, text_col).withColumn("toxic", F.col("p_toxic") >= TOXIC)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
