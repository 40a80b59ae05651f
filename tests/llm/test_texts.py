"""BPE, n-gram join and the pipeline against the tokenizers library and brute force."""

import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from eventloom.operators.graph import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_tokenizer())


def test_bpe_random_texts(library):
    coder = bpe.coder_of(open(bpe.public_tokenizer(), encoding="utf-8").read())
    r = random.Random(1)
    letters = [*"aaabcé ü\n\t's12$_ÀɏßA", "½", "中", "<|endoftext|>", "👍", "\x00", "\x85", "\xa0", "\x1c", "'re", "   ", "aaaa"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        (ids,) = coder.encode([text])
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    coder = bpe.Coder(open(bpe.public_tokenizer(), encoding="utf-8").read())
    for k in range(60):
        text = f"word{k} again word{k // 7} <|endoftext|>"
        assert coder.encode([text]) == [library.encode(text, add_special_tokens=False).ids]
    assert len(coder.known) + len(coder.elder) < 80


def test_bpe_keeps_no_long_pieces(library):
    coder = bpe.Coder(open(bpe.public_tokenizer(), encoding="utf-8").read())
    text = f"{'ab' * 5000} word {'ab' * 5000}"
    assert coder.encode([text, text]) == [library.encode(text, add_special_tokens=False).ids] * 2
    assert max(map(len, coder.known)) <= bpe.KEPT_LENGTH


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.update(normalizer={"type": "NFC"}),
        lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        lambda s: s["pre_tokenizer"].update(use_regex=False),
        lambda s: s.update(pre_tokenizer=None),
        lambda s: s["model"].update(type="Unigram"),
        lambda s: s["model"].update(ignore_merges=True),
        lambda s: s["model"].update(dropout=0.1),
        lambda s: s["added_tokens"][0].update(lstrip=True),
        lambda s: s["model"]["vocab"].update(a=1 << 20),
    ],
)
def test_bpe_refuses_files_of_another_form(change):
    spec = json.loads(open(bpe.public_tokenizer(), encoding="utf-8").read())
    bpe.check_form(spec)
    change(spec)
    with pytest.raises(ValueError, match="tokenizer file"):
        bpe.check_form(spec)


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.op6_bpe(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_odd_rows(odd, none):
    got = {r.doc_id: r for r in bpe.bpe_encode(odd, bpe.public_tokenizer(), keep=["id", "lang"]).collect()}
    assert got[1].ids == got[2].ids == [] and got[1].decoded == "" and got[6].ids == got[7].ids and got[9].id == 1
    assert bpe.bpe_digests(none, bpe.public_tokenizer()).count() == 0


def test_bpe_of_null_ids(spark, library):
    rows = [(None, "a b", 1), (None, "a b", 1), (3, "a b", 2), (None, None, 3), (5, "", 4)]
    df = spark.createDataFrame([(i, t, [n]) for i, t, n in rows], "doc_id long, text string, ids array<int>")
    got = sorted((repr(r.doc_id), r.decoded, r.ids) for r in bpe.bpe_encode(df, bpe.public_tokenizer()).collect())
    assert got == sorted((repr(i), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)


def grams(text):
    w = (text or "").lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets, top = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    links = defaultdict(set)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                top[y] = x
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {i: (root(i), len(links[i])) for i in ids}


def test_ngram_join_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.op7_ngram_join(spark, SF).collect()} == want


@pytest.mark.parametrize("small", [2, 24])
def test_ngram_join_with_large_groups(spark, small):
    """A family of near copies, exact copies, and texts that share a passage only; with small=2 every bucket is a large one."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(12)]
    rows = []
    for k in range(70):
        t = list(base)
        t[r.randrange(60)] = word()
        rows.append((k, " ".join(t)))
    rows += [(100 + k, rows[0][1].upper() if k % 2 else rows[0][1]) for k in range(30)]
    rows += [(200 + k, " ".join(passage + [word() for _ in range(50)])) for k in range(60)]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()
    assert {x.doc_id: x.class_id for x in got} == {i: c for i, (c, _) in brute_classes(rows).items()}
    assert {x.n_copies for x in got if 100 <= x.doc_id < 130} == {31}


@pytest.mark.parametrize("small", [2, 24])
def test_ngram_join_counts_and_lists_every_link(spark, small, monkeypatch):
    """A family of 80 different texts that are nearly all linked, in several blocks; another one that is a chain; copies and strangers."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(200)]
    rows = []
    for k in range(80):
        t = list(base)
        t[r.randrange(200)] = word()
        rows.append((k, " ".join(t)))
    chain = [word() for _ in range(300)]
    for k in range(40):
        chain[k * 7] = word()
        rows.append((100 + k, " ".join(chain)))
    rows += [(200 + k, rows[3 * k][1]) for k in range(5)] + [(300 + k, " ".join(word() for _ in range(30))) for k in range(20)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_classes(rows)
    assert {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.ngram_classes(docs, small=small).collect()} == want
    links = [(x.a, x.b, round(x.jaccard, 9)) for x in ngram_join.ngram_links(docs, small=small)[0].collect()]
    sets = {i: grams(t) for i, t in rows}
    firsts = sorted({sets[i]: i for i, _ in reversed(sorted(rows))}.values())
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert sorted(links) == [(a, b, round(alike(a, b), 9)) for a in firsts for b in firsts if a < b and alike(a, b) >= 0.8]


def test_shared_by_matrix_and_one_by_one(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, 60)).astype(np.uint64) for _ in range(30)]
    wanted = r.random((12, 18)) < 0.4
    want = np.array([[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]) * wanted
    for products, width in ((1, 4096), (1, 7), (10**9, 4096), (0, 64)):
        monkeypatch.setattr(ngram_join, "PRODUCTS", products)
        monkeypatch.setattr(ngram_join, "WIDTH", width)
        assert (ngram_join._shared(sets[:12], sets[12:], wanted) * wanted == want).all()


def test_ngram_join_odd_rows(spark, odd, none):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_classes(odd).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (4, 0), 6: (6, 0), 7: (6, 0), 8: (8, 0), 9: (9, 0)}
    assert ngram_join.ngram_classes(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in ngram_join.ngram_classes(nameless).collect()} == {(None, None), (1, 1)}


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = ngram_join.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert len(got) == 203 and {v for k, v in got.items() if k <= 200} == {0} and got[901] == 900


def test_pipeline(spark):
    """Each stage's own decisions on its own input, by the operators' brute-force checks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.01"
    clean = stage["toxicity"](spark, docs, sf).cache()
    flags = {r.doc_id: r.toxic for r in toxicity.op9_toxicity(spark, sf).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, t in flags.items() if not t}
    once = stage["exact_dedup"](spark, clean, sf).cache()
    norm = lambda t: " ".join(("|" + (t or "") + "|").split())
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(norm(t), i)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())
    near = stage["ngram_jaccard_join"](spark, once, sf).cache()
    want = brute_classes([(r.doc_id, r.text) for r in once.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for c, _ in want.values()})
    mixed = stage["mixing"](spark, near, sf).cache()
    ids = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and len(set(ids)) == len(ids) and set(ids) <= {r.doc_id for r in near.collect()} and len(ids) > 0.3 * near.count()
    coded = stage["bpe"](spark, mixed, sf)
    assert sorted(r.doc_id for r in coded.collect()) == sorted(ids)


def test_pipeline_of_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_decides_by_row(spark, odd, monkeypatch):
    """Repeated and null ids: just the rows that were decided about go, and one of identical rows stays."""
    stage, schema = dict(corpus_pipeline.STAGES), "doc_id long, text string"
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    rows = [(3, "a"), (5, "a"), (5, "unique text"), (None, "a"), (None, "b c"), (None, "b c"), (7, "x"), (7, "x"), (8, None), (8, None)]
    once = stage["exact_dedup"](spark, spark.createDataFrame(rows, schema).repartition(3), SF)
    assert left(once) == sorted([(3, "a"), (5, "unique text"), (None, "b c"), (7, "x"), (8, None)], key=repr)
    assert sorted(r.doc_id for r in stage["exact_dedup"](spark, odd, SF).collect()) == [1, 3, 4, 6, 8, 9]
    words = [f"w{k}" for k in range(200)]
    family = [(k if k % 3 else None, " ".join([*words[: 5 * k], "new", *words[5 * k + 1 :]])) for k in range(40)]
    others = [(2, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, "red green blue white black brown")]
    near = stage["ngram_jaccard_join"](spark, spark.createDataFrame(family + others, schema).repartition(3), SF)
    assert left(near) == sorted([family[1], *others], key=repr)
    monkeypatch.setattr(mixing, "copies", lambda rate, key: F.when(key == 3, 1).otherwise(0))
    assert left(stage["mixing"](spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang"), SF)) == [(3, "a")]


def test_copies_follow_the_rate(spark):
    df = spark.range(20_000).select(mixing.copies(F.lit(0.3), F.col("id")).alias("a"), mixing.copies(F.lit(2.5), F.col("id")).alias("b"))
    a, b = df.agg(F.avg("a"), F.avg("b")).first()
    assert abs(a - 0.3) < 0.02 and abs(b - 2.5) < 0.02
    assert exact_dedup.HOT_SHARE > 0
