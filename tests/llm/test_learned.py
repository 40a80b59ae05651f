"""CRF, classifier chain, mixing: brute force, exact solutions and held-out accuracy; odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import learn, mixing, quality, toxicity
from eventloom.llm.texthash import shingle_hashes, slices, word_hashes

SF = "/root/testdata/sf0.01"


def test_word_and_shingle_hashes():
    texts = ["The cat, the CAT sat", "", None, "cat", "a b c d e f", "a b c d e"]
    ((_, data, starts),) = slices(pa.array(texts))
    words, first = word_hashes(data, starts)
    assert np.diff(first).tolist() == [5, 0, 0, 1, 6, 5]
    assert words[0] == words[2] and words[1] != words[3]
    letters, at = word_hashes(data, starts, letters_only=True)
    assert letters[1] == letters[3] == letters[at[3]]
    grams, at = shingle_hashes(words, first, 5)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 2, 1] and grams[at[4]] == grams[at[5]]


def test_slices_cover_everything():
    rng = np.random.default_rng(0)
    texts = ["x" * int(n) for n in rng.integers(0, 400_000, 40)] + ["y" * 3_000_000]
    got = []
    for first, data, starts in slices(pa.array(texts)):
        assert first == len(got)
        got += [bytes(data[a : b - 1]).decode() for a, b in zip(starts, starts[1:])]
    assert got == texts and list(slices(pa.array([], pa.string()))) == []


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 5, 8])
    unary, edge = rng.normal(size=8), rng.normal(size=(2, 2))
    got = quality.marginals(unary, first, edge)
    forth, back = quality.chain_messages(unary, first, edge)
    pair = quality.pair_marginals(unary, first, edge, forth, back)
    want, want_pair = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights, states = [], list(itertools.product((0, 1), repeat=b - a))
        for s in states:
            weights.append(np.exp(sum(unary[a + k] for k, x in enumerate(s) if x) + sum(edge[x, y] for x, y in zip(s, s[1:]))))
        p = np.array(weights) / sum(weights)
        for q, s in zip(p, states):
            want[a:b] += q * np.array(s)
            for x, y in zip(s, s[1:]):
                want_pair[x, y] += q
    assert np.allclose(got, want) and np.allclose(pair, want_pair)


def test_line_features_know_their_neighbours():
    ((_, data, starts),) = slices(pa.array(["Good line here.\nBAD!!\nBAD!!", ""]))
    x, length, first = quality.line_features(data, starts)
    own = (x.shape[1] - 2) // 3
    assert first.tolist() == [0, 3, 4] and length.tolist() == [15, 5, 5, 0]
    assert np.allclose(x[1, own : 2 * own], x[0, :own]) and np.allclose(x[0, 2 * own : 3 * own], x[1, :own]) and not x[0, own : 2 * own].any()
    assert x[2, own - 2] == 1 and x[1, own - 2] == 0  # the third line stood in the text before


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, labels):
    got = quality.op2_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.95
    assert (got.predicted == got.quality).mean() > 0.93 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_of_odd_rows(spark, odd, none, labels):
    field = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r.score for r in quality.score(odd, field).collect()}
    assert len(got) == 9 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] and got[6] == got[7]
    assert quality.score(none, field).count() == 0
    flat = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, flat).collect()} == {0.5}


@pytest.fixture(scope="module")
def nameless(spark):
    """Rows without ids (one of them twice) beside rows with the same texts, and extra columns named like the operators' own."""
    rows = [(None, "one good line"), (None, "one good line"), (3, "one good line"), (None, None), (5, None), (None, "<div> 77 %% !!")]
    return spark.createDataFrame([(i, t, 9, 0.5, "x") for i, t in rows], "doc_id long, text string, good int, score double, id string")


def test_quality_of_null_ids(spark, nameless, labels):
    field = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = quality.score(nameless, field)
    assert got.columns == ["doc_id", "score"]
    scores = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got.collect())
    named = {i: x for none, i, x in scores if not none}
    others = sorted(x for none, _, x in scores if none)
    assert len(others) == 4 and others.count(named[3]) == 2 and named[5] in others
    assert [r[0] for r in nameless.where("doc_id IS NULL").select(quality.held_out()).collect()] == [False] * 4
    assert quality.train(nameless, labels.select(F.lit(None).cast("long").alias("doc_id"), "quality")).curve == (0.0, 0.0)


def test_toxicity_of_null_ids(spark, nameless, labels):
    chain, _, _ = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, toxicity.label_categories())
    got = [(r.doc_id, r.p_toxic) for r in toxicity.score(nameless, chain, list(toxicity.CATEGORIES)).collect()]
    named = {i: p for i, p in got if i is not None}
    others = [p for i, p in got if i is None]
    assert len(others) == 4 and others.count(named[3]) == 2 and named[5] in others
    kept = toxicity.keep_clean(nameless, chain)
    assert kept.columns == nameless.columns and kept.count() == sum(p < toxicity.TOXIC for _, p in got)


def test_toxicity_chain(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = toxicity.toxicity(docs, train).drop("toxic").join(held, "doc_id").toPandas()
    assert auc(got["p_toxic"].to_numpy(), got["toxic"].to_numpy()) > 0.85


def test_chain_uses_earlier_categories_out_of_fold():
    rng = np.random.default_rng(0)
    y0 = (rng.random(2000) < 0.5).astype(float)
    y = np.column_stack((y0, y0))
    owner = np.flatnonzero(y0 * (rng.random(2000) < 0.95))
    chain, oof = toxicity.fit_chain(owner, np.full(len(owner), 7, np.uint64), rng.normal(size=(2000, 10)), y)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert np.abs(chain.weights[1][-2]) > 0.5  # the weight of the first category's probability
    assert ((oof[:, 1] > 0.5) == (y0 == 1)).mean() > 0.9


def brute_chain(rows, look, y, group, most, folds):
    """Out-of-fold probabilities of a chain, with sets of words and plain loops; rows: a set of words each."""

    def words_of(some):
        best = {}
        for w in sorted(set().union(*(rows[i] for i in some))):
            have = [i for i in some if w in rows[i]]
            scores = [0.0]
            for c in range(y.shape[1]):
                share = sum(y[i, c] for i in some) / len(some)
                if 0 < share < 1:
                    scores.append((sum(y[i, c] for i in have) - len(have) * share) ** 2 / (len(have) * share * (1 - share)))
            best[w] = max(scores) if len(have) >= 5 else 0.0
        return sorted(w for w in sorted(best, key=lambda w: -best[w])[:most] if best[w] > 0)

    out = np.zeros_like(y)
    for c in range(y.shape[1]):
        for k in range(folds):
            test, rest = [i for i in range(len(rows)) if group[i] % folds == k], [i for i in range(len(rows)) if group[i] % folds != k]
            chosen, middle, spread = words_of(rest), look[rest].mean(axis=0), np.maximum(look[rest].std(axis=0), 1e-6)
            x = np.array([[float(w in rows[i]) for w in chosen] + list((look[i] - middle) / spread) + list(out[i, :c]) for i in range(len(rows))])
            w = learn.fit_logistic(x[rest], y[rest, c])
            out[test, c] = [1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1]))) for i in test]
    return out


def test_chain_against_brute_force():
    rng = np.random.default_rng(4)
    y = np.column_stack((rng.random(240) < 0.4, rng.random(240) < 0.3)).astype(float)
    rows = [{int(w) for w in rng.integers(1, 60, 12)} | ({100} if a and rng.random() < 0.8 else set()) | ({200} if b and rng.random() < 0.7 else set()) for a, b in y]
    look, group = rng.normal(size=(240, 3)), rng.integers(0, 100, 240)
    owner = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    _, oof = toxicity.fit_chain(owner, np.array([w for r in rows for w in sorted(r)], np.uint64), look, y, group, most=7, folds=5)
    assert np.allclose(oof, brute_chain(rows, look, y, group, 7, 5), atol=1e-6)


def test_out_of_fold_probabilities_know_nothing_of_their_fold():
    """Labels that nothing tells: words chosen with the fold's own rows would seem to tell them."""
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.5).astype(float)[:, None]
    owner, words = np.repeat(np.arange(600), 40), rng.integers(0, 3000, 24_000).astype(np.uint64)
    _, oof = toxicity.fit_chain(owner, words, rng.normal(size=(600, 3)), y)
    assert abs(auc(oof[:, 0], y[:, 0]) - 0.5) < 0.08


def test_equal_content_shares_a_fold():
    look = np.array([[1.0], [2.0], [1.0]])
    place, group = toxicity.content_order(np.array([0, 1, 2]), np.array([5, 5, 5], np.uint64), look)
    assert group[0] == group[2] != group[1] and sorted(place) == [0, 1, 2]


def test_toxicity_of_odd_rows(odd, none, spark, labels):
    chain, _, _ = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, toxicity.label_categories())
    got = toxicity.score(odd, chain, list(toxicity.CATEGORIES)).collect()
    assert len(got) == 10 and all(0 <= p <= 1 for r in got for p in r[1:])
    kept = toxicity.keep_clean(odd, chain)
    assert kept.columns == odd.columns and kept.count() == sum(r.p_toxic < toxicity.TOXIC for r in got)
    assert toxicity.keep_clean(none, chain).count() == 0 and toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 10


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet((0.3, 0.3, 0.3), 500)
    tokens = rng.integers(1, 2000, 500)
    df = spark.createDataFrame([(int(n), [float(x) for x in r]) for n, r in zip(tokens, p)], "n_tokens long, posteriors array<double>").repartition(3)
    steps, report = mixing.fit_rates(df, [0.5, 0.3, 0.2])
    rate, _ = mixing.replay(p, steps, float("inf"))
    assert rate.min() >= 0 and np.allclose(report["totals"], (tokens * rate) @ p) and np.allclose(report["totals"], report["targets"], rtol=1e-3)
    # the least-squares optimum in the metric of the tokens, by plain projected gradient descent
    have, rate2 = (tokens[:, None] * p), np.ones(500)
    step = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    for _ in range(20_000):
        rate2 = np.clip(rate2 - step * (p @ (have.T @ rate2 - np.array(report["targets"]))), 0, None)
    assert np.allclose(have.T @ rate2, report["totals"], rtol=1e-3)


def test_rates_bounded_by_one(spark):
    df = spark.createDataFrame([(100, [0.9, 0.1])] * 30 + [(100, [0.2, 0.8])] * 10, "n_tokens long, posteriors array<double>")
    steps, report = mixing.fit_rates(df, [0.5, 0.5], max_rate=1.0)
    rate, _ = mixing.replay(np.array([[0.9, 0.1], [0.2, 0.8]]), steps, 1.0)
    assert rate.max() <= 1 and rate[0] < rate[1]


def test_mixing(spark, odd, none, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.op8_mixing(spark, SF).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all() and (got.copies - got.rate).abs().max() < 1
    known = got.merge(docs.join(labels, "doc_id").toPandas(), on="doc_id")
    truth = np.where(known.quality == 0, "junk", known.lang)
    assert (known.likeliest == truth).mean() > 0.9
    totals = got.groupby("likeliest").apply(lambda g: (g.n_tokens * g.rate).sum(), include_groups=False)
    assert abs(totals["en"] / totals.sum() - mixing.WEIGHTS["en"]) < 0.05
    labelled = mixing.label_domains(docs, labels)
    assert mixing.mix(odd, labelled)[0].count() == 10 and mixing.mix(none, labelled)[0].count() == 0
    assert np.allclose(got.groupby("likeliest").domain_total.first() / got.groupby("likeliest").domain_target.first(), 1, rtol=0.02)
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "d e")], "doc_id long, text string")
    assert [r.n_tokens for r in mixing.mix(nameless, labelled)[0].where("doc_id IS NULL").collect()] == [3, 3]


def test_softmax_and_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=600) > 0).astype(int)
    assert ((learn.predict_logistic(x, learn.fit_logistic(x, y)) > 0.5) == y).mean() > 0.95
    w = learn.fit_softmax(x, y + (x[:, 1] > 1), 3)
    assert (np.column_stack((x, np.ones(600))) @ w).argmax(axis=1).shape == (600,)


def test_samples_have_bounds(spark):
    """Rows, lines and bytes that a sample may have are parameters; texts beyond them are left out of the fit alone."""
    texts = [(k, ("word " * 5 if k % 2 else "?! ## ") * (1 + 40 * (k % 3)) + "\nx" * (k % 4)) for k in range(40)]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    whole, short = quality.train(docs, marks), quality.train(docs, marks, sample_bytes=60)
    assert not np.allclose(whole.middle, short.middle)
    assert np.allclose(short.middle, quality.train(docs.where("octet_length(text) <= 60"), marks).middle)
    few = quality.train(docs, marks, sample_lines=2)
    assert np.allclose(few.middle, quality.train(docs.where("size(split(text, '\\n')) <= 2"), marks).middle)
    assert quality.train(docs, marks, sample_lines=0).weights.size == 1


def test_lists_of_chunks_as_arrays():
    column = pa.chunked_array([pa.array([[1.0, 2.0], [], [3.0]]), pa.array([[9.0], [4.0, 5.0]]).slice(1), pa.array([], pa.list_(pa.float64()))])
    assert [a.tolist() for a in quality._arrays(column)] == [[1.0, 2.0], [], [3.0], [4.0, 5.0]]
