"""Embedding whitening, URL filter and fill-in-middle against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import middle, url_filter, whitening

VECTORS = "vec_id long, embedding array<float>, label int, key string, x long, rows int, weight double"


def brute_whiten(rows, components=16, counted=False):
    """{(id, component): (n, deviation, |whitened|, explained)} of (id, vector) rows of one length."""
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if counted else sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array(fit, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = defaultdict(list)
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        z = (np.array(x, float) - np.array(sums) / n) @ v
        for k in range(min(components, d)):
            out[i, k + 1].append((n, dev, abs(z[k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(n + k, rows[0][1]) for k in range(4 * n)]  # one vector has most rows
    rows += [(900_000, None), (900_001, [None] * d), (900_002, [float("nan")] + [0.0] * (d - 1)), (900_003, [float("-inf")] + [1.0] * (d - 1)), (None, rows[1][1]), (5, rows[2][1])]
    return rows


@pytest.mark.parametrize("counted", [False, True])
def test_whitening_equals_brute_force(spark, counted):
    rows = vectors(1, 60, 20)
    df = spark.createDataFrame([(i, v, 1, "k", 2, 3, 0.5) for i, v in rows], VECTORS).repartition(7)
    want = brute_whiten(rows, counted=counted)
    got = whitening.whiten(df, counted=counted).collect()
    assert len(got) == sum(len(v) for v in want.values())
    for r in got:
        close = [w for w in want[r.vec_id, r.component] if r.n == w[0] and r.deviation == w[1] and abs(abs(r.whitened) - w[2]) < 1e-9 and abs(r.explained / w[3] - 1) < 1e-9]
        assert close, r
        assert r.identity_error < 1e-9
    # one sign for all rows: equal vectors have equal results to the last bit
    hot = {(r.component, r.whitened) for r in got if r.vec_id is not None and 60 <= r.vec_id < 300}
    assert len(hot) == 16


def test_whitening_of_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, []), (3, [float("inf")])])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()  # no spread: nothing to whiten
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 4
    mixed = whitening.whiten(make([(1, [1.0]), (2, [2.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [1e300])])).collect()  # lengths are apart; entries are clipped
    assert sorted({(r.vec_id, r.n) for r in mixed}) == [(1, 3), (2, 3), (3, 2), (4, 2), (5, 3)]
    assert [r.deviation for r in mixed if r.vec_id == 5] == [None]
    flat = {(r.vec_id, r.component): r for r in mixed if r.vec_id in (3, 4)}
    assert abs(flat[3, 1].whitened) == pytest.approx(1) and flat[3, 2].whitened is None


def brute_urls(pages, outcomes, rules=url_filter.RULES):
    """{(page_id, url): (host, path, rule, verdict, labelled, rate, low)} by plain loops."""
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, 0), int(b))
    count = defaultdict(lambda: [0, 0])
    parsed = []
    for i, url in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        name = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", host.rsplit("@", 1)[-1]))
        parsed.append((i, url, host, path, name))
        count[name]  # noqa: B018
        if i in bad:
            count[name][0] += 1
            count[name][1] += bad[i]

    def places(name):
        labels = name.split(".")
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", name) or name.startswith("["):
            return name, "ip"
        k = 2 if ".".join(labels[-2:]) in url_filter.LONG_SUFFIXES else 1
        return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])

    domains, suffixes, of = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), {}
    for name, (n, x) in count.items():
        d, s = places(name)
        of[name] = (d, s)
        for total in (domains[d, s], suffixes[s]):
            total[0] += n
            total[1] += x

    def weight(children):
        excess = sum((x - n * p) ** 2 - n * p * (1 - p) for n, x, p in children)
        pairs = sum(n * (n - 1) * p * (1 - p) for n, x, p in children)
        return 10.0 if not pairs else 1 / min(max(excess / pairs, 1 / 1001), 1 / 2) - 1

    n_all, x_all = sum(n for n, _ in suffixes.values()), sum(x for _, x in suffixes.values())
    top = {s: (x_all - x + 1) / (n_all - n + 2) for s, (n, x) in suffixes.items()}
    k = weight([(n, x, top[s]) for s, (n, x) in suffixes.items()])
    mid = {(d, s): (k * top[s] + suffixes[s][1] - x) / (k + suffixes[s][0] - n) for (d, s), (n, x) in domains.items()}
    k = weight([(n, x, mid[d]) for d, (n, x) in domains.items()])
    low = {h: (k * mid[of[h]] + domains[of[h]][1] - x) / (k + domains[of[h]][0] - n) for h, (n, x) in count.items()}
    k = weight([(n, x, low[h]) for h, (n, x) in count.items()])
    out = defaultdict(list)
    for i, url, host, path, name in parsed:
        n, x = count[name]
        a, b = k * low[name] + x, k * (1 - low[name]) + n - x
        bound = 1 / (1 + math.exp(url_filter.Z * math.sqrt(1 / a + 1 / b) - math.log(a / b)))
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit) if fit else (0, None, "block" if bound > 0.5 else "allow")
        out[i, url].append((host, path, rule[1], rule[2], n, round(a / (a + b), 5), round(bound, 5)))
    return out


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["good.example.org", "BAD.example.org", "a.spam.org", "b.spam.org", "c.spam.org", "new.spam.org", "x.com", "www.Example.com", "example.com", "m.example.com", "evilexample.com", "q.net", "net", "10.0.0.1", "[::1]:8080", "u@h.co.uk:80", "h.co.uk."]
    paths = ["", "/", "/en/1", "/es/", "/fr", "/fr/2?x=/en/", "/EN/", "?q=/en/", "#://other.org/en/"]
    pages = [(k, f"http{'s' if k % 2 else ''}://{rng.choice(hosts)}{rng.choice(paths)}") for k in range(900)]
    pages += [(k, "https://hot.example.org/page") for k in range(900, 2400)]  # a hot host
    pages += [(None, "http://x.com/"), (7, "http://x.com/"), (7, "http://x.com/"), (2500, None), (2501, ""), (2502, "no scheme"), (2503, "a://b://c/"), (2504, "http://li\nne.org/a\nb")]
    outcomes = [(i, bool("BAD" in (u or "") or "a.spam" in (u or "") or "b.spam" in (u or "") or rng.random() < 0.1)) for i, u in pages if i is not None and "new." not in (u or "") and rng.random() < 0.7]
    outcomes += [(7, True), (8, None), (None, True)]
    df = spark.createDataFrame([(i, u, "h", "n", 1) for i, u in pages], "page_id long, url string, host string, name string, bad int").repartition(6)
    got = defaultdict(list)
    rows = url_filter.url_filter(df, spark.createDataFrame(outcomes, "page_id long, bad boolean")).collect()
    urls = defaultdict(list)
    for i, u in pages:
        urls[i].append(u)
    want = brute_urls(pages, outcomes)
    for r in rows:
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict, r.labelled, r.bad_rate, r.bad_low))
    near = lambda a, b: a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4
    assert len(rows) == len(pages)
    for i, all_urls in urls.items():
        expected = sorted(w for u in set(all_urls) for w in want[i, u])
        assert all(near(a, b) for a, b in zip(sorted(got[i]), expected, strict=True)), (i, got[i], expected)
    said = {r.host: r.verdict for r in rows if r.rule is None}
    assert said["bad.example.org"] == "block" and said["good.example.org"] == "allow" and said["a.spam.org"] == "block" and said["hot.example.org"] == "allow"


def test_url_filter_without_pages_labels_or_rules(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")
    assert url_filter.url_filter(pages, labels).count() == 0
    some = spark.createDataFrame([(1, "http://example.com/en/"), (2, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.labelled, r.bad_rate) for r in url_filter.url_filter(some, labels, rules=()).collect()}
    assert got == {1: (None, "allow", 0, 0.5), 2: (None, "allow", 0, 0.5)}


def test_posterior_bound_is_near_the_exact_quantile():
    rng = np.random.default_rng(0)
    for a, b in ((40, 60), (9, 3), (3, 12), (150, 20)):
        exact = np.quantile(rng.beta(a, b, 400_000), 0.05)
        assert abs(1 / (1 + math.exp(url_filter.Z * math.sqrt(1 / a + 1 / b) - math.log(a / b))) - exact) < 0.04


def test_url_filter_stays_in_the_jvm(spark, sf):
    plan = url_filter.op12_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def brute_middle(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    return (len(units), form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), out)


def texts():
    rng = random.Random(5)
    words = ["alpha", "é", "漢字", "<", "P>", "<S", "𝕏", "\t", "  ", "omega.", "\r"]
    passage = "\n".join(" ".join(rng.choices(words, k=30)) for _ in range(200))
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x <M> y\nz", "<P>", "no line end " * 3000, "漢" * 40_000 + "\n" + "é" * 9000, passage, "\n" * 5000]
    out += ["".join(rng.choices(words, k=rng.randrange(3000))).replace("omega.", "omega.\n") for _ in range(60)]
    return out + [f"{'intro ' * k}\n{passage}\n{k}" for k in range(20)]


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts())] + [(5, "a\n"), (5, "a\n"), (-7, "neg\nid\n")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, form string, n int, cut string").repartition(5)
    for rate, spm in ((100, 50), (60, 30)):
        made = middle.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[-1])
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key)
        want = sorted(((i, *brute_middle(i, t, rate, spm)) for i, t in rows), key=key)
        assert got == want
        assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)


def test_fill_in_middle_of_odd_rows(odd, none):
    got = middle.fill_in_middle(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "chunks", "output"]
    assert middle.fill_in_middle(none).count() == 0


def test_chunks_follow_the_content():
    """Chunks add up to the text, end at characters, are bounded, and shared passages share them wherever they stand."""
    every = [(t or "").encode() for t in texts()]
    for data in every:
        ends = middle.chunk_ends(np.frombuffer(data, np.uint8))
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(data) and (sizes > 0).all() and sizes.max(initial=0) <= middle.MOST
        assert not any(data[e] & 0xC0 == 0x80 for e in ends[:-1])
    pieces = lambda data, ends: {data[a:b] for a, b in zip([0, *ends], ends)}
    one, other = (pieces(data, middle.chunk_ends(np.frombuffer(data, np.uint8))) for data in (every[-1], every[-12]))
    assert len(one & other) > 0.6 * len(one)


def test_blocks_do_not_change_chunks(monkeypatch):
    data = np.frombuffer("".join(t or "" for t in texts()).encode(), np.uint8)
    whole = middle.chunk_ends(data)
    monkeypatch.setattr(middle, "BLOCK", 1000)
    assert middle.chunk_ends(data) == whole


def test_cache_is_bounded_and_hits():
    cache = middle.ChunkCache(most=20_000)
    for t in texts():
        middle.cut((t or "").encode(), 1, 2, cache)
    assert cache.hits > 0
    assert sum(map(len, cache.new)) <= 20_000 + middle.MOST and sum(map(len, cache.old)) <= 20_000 + middle.MOST
