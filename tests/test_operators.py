import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import cluster, match, metrics, pages, rank, verdicts, windows
from eventloom.sources import io
from eventloom.streaming import incremental

RULES = "company_id string, term string, negative array<string>, required array<string>, forbidden boolean, forbidden_required array<string>, english_negative array<string>, english_required array<string>"


def found(spark, text, *rules):
    terms = spark.createDataFrame([(r.get("id", "c"), r["term"], *(r.get(k) for k in ("negative", "required", "forbidden", "forbidden_required", "english_negative", "english_required"))) for r in rules], RULES)
    a = spark.createDataFrame([(1, text)], "seq long, title string")
    return {(m.company_id, *m.matched_terms) for m in match.matches(a, terms, "seq", F.col("title")).collect()}


def test_boundaries_and_spacing(spark):
    assert found(spark, "The ACME-X unit", {"term": "Acme"}) == {("c", "Acme")}
    assert found(spark, "The acmex unit", {"term": "acme"}) == set()
    assert found(spark, "알파 컴퍼니 소식", {"term": "알파컴퍼니"}) == {("c", "알파컴퍼니")}
    assert found(spark, "a – b c++ x", {"term": "c++"}) == {("c", "c++")}


def test_contexts(spark):
    assert found(spark, "Alpha Centauri seen", {"term": "alpha", "negative": ["alpha centauri"]}) == set()
    assert found(spark, "Alpha sees Alpha Centauri", {"term": "alpha", "negative": ["alpha centauri"]}) == {("c", "alpha")}
    assert found(spark, "alpha deal", {"term": "alpha", "required": ["chip"]}) == set()
    forbidden = {"term": "alpha", "forbidden": True, "forbidden_required": ["chip"], "negative": ["star"]}
    assert found(spark, "alpha chip", forbidden) == {("c", "alpha")}
    assert found(spark, "alpha chip star", forbidden) == set()
    assert found(spark, "alpha", {"term": "alpha", "forbidden": True}) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_equals_the_join(spark, seed):
    """Random texts and dictionaries with Korean terms, boundaries, overlapping negatives and every kind of context."""
    rng = random.Random(seed)
    words = ["alpha", "alpha-x", "beta", "c++", "x", "알파", "컴퍼니", "알파 컴퍼니", "베타", "aa", "★", "a a", "3m", "alphabet"]
    glue = [" ", "", "-", "\n", ". ", "–", "\t"]
    text = lambda n: "".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) + rng.choice(glue) for _ in range(n))
    some = lambda p: rng.sample(words, rng.randrange(1, 4)) if rng.random() < p else (None if rng.random() < 0.5 else [])
    rules = [(f"c{rng.randrange(4)}", rng.choice(words) if rng.random() < 0.8 else f"{rng.choice(words)} {rng.choice(words)}", some(0.4), some(0.2), rng.random() < 0.2, some(0.5), some(0.2), some(0.2)) for _ in range(25)]
    terms = spark.createDataFrame(rules, RULES)
    articles = spark.createDataFrame([(k, text(rng.randrange(12))) for k in range(300)] + [(900, None), (901, "")], "seq long, title string").repartition(3)
    ways = [{(r.seq, r.company_id, *r.matched_terms) for r in match.matches(articles, terms, "seq", F.col("title"), most_terms=most).collect()} for most in (1000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) > 100


def test_no_terms_and_no_articles(spark):
    none = spark.createDataFrame([], RULES)
    assert match.matches(spark.createDataFrame([(1, "x")], "seq long, title string"), none, "seq", F.col("title")).count() == 0
    assert found(spark, "", {"term": "a"}) == set()


def test_longest_evidence(spark):
    assert found(spark, "alpha-x grows", {"term": "alpha"}, {"term": "alpha-x"}) == {("c", "alpha-x")}


@pytest.mark.parametrize(("seed", "chunk"), [(1, 100_000), (2, 15)])
def test_shared_caps_equal_the_greedy_loop(spark, seed, chunk):
    r = random.Random(seed)
    items = [(k, k, r.sample("abcdef", r.choice((1, 1, 2, 3)))) for k in range(40)]
    full, want = {}, set()
    for i, _, cs in items:
        if all(full.get(c, 0) < 3 for c in cs):
            want.add(i)
            for c in cs:
                full[c] = full.get(c, 0) + 1
    df = spark.createDataFrame(items, "item_id long, rank long, companies array<string>")
    assert {x.item_id for x in rank.capped_shared(df, 3, chunk=chunk).collect()} == want
    assert [x.item_id for x in rank.capped_shared(df, 3, 5, chunk).collect()] == sorted(want)[:5]


def test_shared_caps_of_odd_items(spark):
    rows = [(1, 1, None), (2, 2, []), (3, 3, ["a", "a"]), (4, 4, ["a"]), (5, 5, ["a", None]), (6, 6, ["b"])]
    df = spark.createDataFrame(rows, "item_id long, rank long, companies array<string>")
    assert {x.item_id for x in rank.capped_shared(df, 2).collect()} == {1, 2, 3, 4, 6}
    assert rank.capped_shared(df.limit(0), 2).count() == 0


def test_a_hot_company_is_closed_at_once(spark, monkeypatch):
    """Nine in ten items share a company: it is full after the first round, whatever the number of its items."""
    written = []
    monkeypatch.setattr(rank, "stored", lambda df, name, f=rank.stored: written.append(name) or f(df, name))
    rows = [(k, k, ["hot", f"c{k % 5}"] if k % 10 else [f"c{k % 5}"]) for k in range(5000)]
    df = spark.createDataFrame(rows, "item_id long, rank long, companies array<string>")
    assert {x.item_id for x in rank.capped_shared(df, 3, chunk=50).collect()} == {0, 1, 2, 3, 10, 20}
    assert written.count("caps-chunk") <= 4


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21])
def test_latency_ranks(spark, n):
    values = sorted(float(k) for k in range(n))
    got = metrics.latencies(spark.createDataFrame([("x", v) for v in values], "s string, v double"), "v", ["s"]).first()
    assert (got.p50, got.p95, got.max) == (values[(n - 1) // 2], values[min(n - 1, int(0.95 * n))], values[-1])


def test_gates(spark):
    out = lambda n, m: spark.createDataFrame([("success",)] * n + [("other",)] * m, "status string")
    assert metrics.coverage_gate(out(9, 1)).first().sufficient
    assert not metrics.coverage_gate(out(147, 17)).first().sufficient
    with pytest.raises(Exception, match="no query"):
        metrics.coverage_gate(out(0, 0)).collect()
    assert not metrics.systemic_failure(out(0, 0), F.col("status") == "other").first().systemic
    assert metrics.systemic_failure(out(9, 3), F.col("status") == "other").first().systemic


def test_windows():
    from datetime import datetime, timedelta, timezone

    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert windows.delivery_window(now, None)[0] == now - timedelta(hours=30)
    assert windows.delivery_window(now, now - timedelta(hours=24))[0] == now - timedelta(hours=26)
    with pytest.raises(ValueError):
        windows.delivery_window(datetime(2026, 1, 2), None)
    assert windows.lookback_days(now - timedelta(hours=30), now, 7) == 2


@pytest.mark.parametrize(
    ("html", "tier", "needle"),
    [
        ('<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"Head line","articleBody":"A body of some length"}]}</script>', "jsonld", "A body of some length"),
        ("<article><p>Enough words for a text here</p><div class='related-links'>no</div><nav>menu</nav></article>", "article_tag", "Enough words"),
        ("<main><p>Enough words for a text here</p></main>", "main_tag", "Enough words"),
        ('<title>A title here</title><meta name="description" content="and a description">', "opengraph", "and a description"),
        ("<p>stray text that is long enough to count</p>", None, ""),
    ],
)
def test_page_evidence(html, tier, needle):
    text, got = pages.evidence(html)
    assert got == tier and needle in (text or "") and "menu" not in (text or "") and " no" not in (text or "")


def test_two_tiers_default(spark):
    c = spark.createDataFrame([("1", ["supply"])], "candidate_id string, families array<string>")
    none = spark.createDataFrame([], "candidate_id string, code string")
    got = verdicts.two_tier(c, none, none).first()
    assert (got.qualifies, got.family, got.materiality, got.decided_by) == (True, "supply", "low", "conservative")


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link>https://a.com/?utm_x=1</link><description>d</description><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate><source>S</source></item><item><title>t</title></item></channel></rss>")
    got = io.feed_articles(io.read_feed(spark, str(tmp_path)), "q").collect()
    assert [(g.title, g.canonical_url, g.description, g.source, g.query) for g in got] == [("A & B", "https://a.com/", "d", "S", "q")]


def test_snapshots(spark, tmp_path):
    """Both places; an article without the id it was saved with stays; a run without articles is an error of the whole."""
    one = {"article_id": "1", "title": "t", "url": "u", "canonical_url": "c", "origin_metadata": {"query": "q", "n": [1, None]}, "published_at": "2026-01-01T00:00:00Z"}
    for name, run in (("a", {"stages": {"enrichment": {"articles": [one, {"title": "kept", "url": "v"}]}}}), ("b", {"debug": {"journal_stages": {"enrichment": {"articles": [one | {"title": "second place"}]}}}})):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / f"{name}.json").write_text(json.dumps(run, indent=2))
    got = io.read_snapshot(spark, str(tmp_path / "runs")).collect()
    assert sorted((r.title, r.url, r.canonical_url) for r in got) == [("kept", "v", "v"), ("second place", "u", "c"), ("t", "u", "c")]
    assert json.loads(next(r.origin_metadata for r in got if r.title == "t")) == one["origin_metadata"]
    (tmp_path / "runs" / "c.json").write_text('{"stages": {"enrichment": {"articles": []}}}')
    with pytest.raises(ValueError, match="c.json"):
        io.read_snapshot(spark, str(tmp_path / "runs"))


def test_judgments(spark, tmp_path):
    article = dict.fromkeys(io.REQUIRED) | {"title": "t", "url": "u", "published_at": "2026-01-01T00:00:00+00:00", "origin_metadata": {}}
    exposure = {"exposure_id": "e", "subject": "s", "allowed_event_families": ["f"]}
    less = {k: v for k, v in article.items() if k not in ("text", "retrieved_at")}
    rows = [
        {"company": "c", "article": article, "exposure": exposure, "judge": {"qualifies": False, "audit": {"final_decision": "ACCEPT"}}}, {"company": "c", "article": article, "exposure": exposure, "judge": {"qualifies": True, "audit": {"final_decision": "x"}}},
        {"company": "c", "article": article, "exposure": exposure}, {"company": "c", "article": less, "exposure": exposure, "judge": {}}, {"company": "c", "article": article, "exposure": {"exposure_id": "e"}, "judge": {}}, {"company": "c", "exposure": exposure},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"debug": {"route_b": {"judgments": rows[:4]}}}))
    (tmp_path / "b.json").write_text(json.dumps({"stages": {"qualification": {"judgments": rows[4:]}}}))
    good, bad = io.read_judgments(spark, str(tmp_path / "*.json"))
    assert sorted(r.baseline for r in good.collect()) == ["ACCEPT", "ACCEPT", "REJECT"]
    assert {(r.canonical_url, r.published_at.year, tuple(r.families)) for r in good.collect()} == {("u", 2026, ("f",))}
    assert sorted(r.reason for r in bad.collect()) == ["article lacks " + ", ".join(sorted(io.REQUIRED)), "article lacks retrieved_at, text", "record lacks company or exposure"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<link href="/a" rel="canonical"><a href="/b">', ["https://h.example/a", "https://h.example/b"]),
        ("<a href='../x'><a href='?q=1&amp;r=2'><a href=#top><a href='//other.example/y'>", ["https://h.example/x", "https://h.example/d/p?q=1&r=2", "https://h.example/d/p?old=1#top", "https://other.example/y"]),
        ('<link rel="canonical"><link rel="canonical" href="/late"><meta property="og:url" content="z"><meta name="og:url" content="no">', ["https://h.example/d/z"]),
        ("<!-- <a href='/c'> --><script>'<a href=\"/s\">'</script><A HREF=/u>", ["https://h.example/u"]),
        ("<a href='http://[bad/'><a href=' /sp '>", ["https://h.example/sp"]),
        (None, []),
    ],
)
def test_page_targets(html, want):
    assert [x.strip() for x in pages.page_targets(html, "https://h.example/d/p?old=1")] == want


def test_metas_are_told_apart():
    """og:... is a property, the others are names; only the first tag of a key counts."""
    text, tier = pages.evidence('<title>Some title</title><meta name="og:title" content="wrong one"><meta property="description" content="wrong two"><meta name="description"><meta name="description" content="late"><meta property="og:title" content="right title here">')
    assert tier == "opengraph" and text == "Some title right title here"


def test_latencies_of_a_hot_group(spark):
    """A group of all rows, all values distinct, and null groups."""
    rows = [("hot", float(k)) for k in range(20_000)] + [(None, 3.0), (None, 1.0), ("none", None)]
    got = {r.s: (r.p50, r.p95, r.max) for r in metrics.latencies(spark.createDataFrame(rows, "s string, v double").repartition(8), "v", ["s"]).collect()}
    assert got == {"hot": (9999.0, 19000.0, 19999.0), None: (1.0, 3.0, 3.0), "none": (0.0, 0.0, 0.0)}


def test_stream_dedup_and_delivery(spark, tmp_path):
    """Three batches: keys of earlier batches keep rows out of later ones; a batch that comes twice changes nothing; fingerprints are delivered once."""
    batches = [[(1, "u", "t", "f1"), (2, "u", "x", "f2")], [(3, "v", "y", "f1"), (4, "u", "z", "f3"), (5, "", "t", "f4")], [(6, "w", "x", "f5"), (7, "v", "", "f6"), (8, "", "", "f7")]]
    shape = "seq long, url_key string, title_key string, fingerprint string"
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    keep = incremental.dedup_batches(out, state)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run_batches(stream, keep, str(tmp_path / "cp")).awaitTermination()
    keep(spark.createDataFrame(batches[1], shape), 1)
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/*").collect()) == [1, 3, 6, 8]
    deliver = incremental.deliver(str(tmp_path / "sent"), str(tmp_path / "ledger"))
    for k in (0, 1, 1, 2):
        deliver(spark.read.parquet(f"{out}/batch={k}").select("fingerprint"), k)
    assert sorted(r.fingerprint for r in spark.read.parquet(f"{tmp_path}/sent/*").collect()) == ["f1", "f5", "f7"]


def test_watermarked_prefilter(spark, tmp_path):
    rows = [("2026-01-01 00:00:00", "a"), ("2026-01-01 00:10:00", "a"), ("2026-01-01 01:00:00", "b")]
    spark.createDataFrame(rows, "at string, canonical_url string").selectExpr("timestamp(at) AS published_at", "canonical_url").write.parquet(str(tmp_path / "in"))
    stream = incremental.fresh_stream(spark, str(tmp_path / "in"), "published_at timestamp, canonical_url string")
    incremental.run_batches(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.canonical_url for r in spark.read.parquet(f"{tmp_path}/out/*").collect()) == ["a", "b"]


@pytest.mark.parametrize("chunk", [2, 5, 100])
def test_greedy_groups_against_brute_force(spark, chunk):
    """Complete linkage in order, whatever part of a component is settled at once."""
    rng = random.Random(7)
    order = list(range(40))
    links = {(a, b) for a in order for b in order if a < b and (a // 8 == b // 8 and rng.random() < 0.8 or rng.random() < 0.05)}
    same = lambda a, b: (min(a, b), max(a, b)) in links
    groups = []
    for row in order:
        home = next((g for g in groups if all(same(row, x) for x in g)), None)
        if home is None:
            groups.append([row])
        else:
            home.append(row)
    rows = spark.createDataFrame([(k, f"{k:04d}") for k in order], "id long, ord string")
    got = cluster.greedy_groups(rows, spark.createDataFrame(sorted(links), "l long, r long"), chunk).collect()
    assert sorted((r.id, r.group) for r in got) == sorted((x, g[0]) for g in groups for x in g)


def test_corroborating_against_brute_force(spark):
    rng = random.Random(2)
    members = [(g, f"m{g}{k}", k + 1, f"https://h/{'x' * rng.randrange(4)}{k}", rng.randrange(3), [f"w{x}" for x in sorted(rng.sample(range(9), 3))]) for g in range(6) for k in range(g + 1)]
    want = []
    for g in range(6):
        part = sorted((m for m in members if m[0] == g), key=lambda m: (m[3].lower(), m[1]))
        seen, left = set(next(m[5] for m in part if m[2] == 1)), [m for m in part if m[2] > 1]
        for pick in range(1, 4):
            if left:
                best = min(left, key=lambda m: (-len(set(m[5]) - seen), -m[4], len(m[3]), m[3].lower(), m[1]))
                left.remove(best)
                seen |= set(best[5])
                want.append((g, pick, best[1]))
    df = spark.createDataFrame(members, "group long, id string, rank int, url string, total int, words array<string>")
    none = F.array().cast("array<string>")
    facts = F.struct(*(none.alias(k) for k in ("primary", "parties", "milestones", "dates", "amounts", "percentages")), F.col("words").alias("subjects"))
    got = cluster.corroborating(df.withColumn("score", F.struct("total")).withColumn("facts", facts)).collect()
    assert sorted((r.group, r.pick, r.id) for r in got) == want


def test_identity_groups_need_title_and_time(spark):
    t = "2026-01-01 00:00:00"
    rows = [(1, "u1", "same title", "Desk", t), (2, "u2", "same title", " DESK", t), (3, "u3", "same title", "desk", None), (4, "u4", "same title", "desk", None), (5, "u5", "", "desk", t), (6, "u6", "", "desk", t), (7, "U1 ", "other", "x", None), (8, "", "p", "x", t), (9, "", "q", "x", t)]
    df = spark.createDataFrame(rows, "id long, url_key string, title_key string, source string, at string").withColumn("published_at", F.col("at").cast("timestamp"))
    got = {r.id: r.label for r in cluster.identity_groups(df).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 3: 3, 4: 4, 5: 5, 6: 6, 8: 8, 9: 9}
