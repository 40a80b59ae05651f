"""Facts in Korean and English, conflicts, the pair ladder and clustering on hand-made rows."""

import random
from datetime import datetime, timedelta

import pytest

from eventloom.functions import facts as ft
from eventloom.functions import text as t
from eventloom.operators import cluster, dedup
from eventloom.sources import views
from pyspark.sql import functions as F

ARTICLE = "id string, company string, title string, description string, text string, url string, source string, published_at timestamp"


def articles(spark, titles, when=None, company="Alpha"):
    when = when or [datetime(2026, 7, 20, 9)] * len(titles)
    return spark.createDataFrame([(f"a{k:03d}", company, x, None, None, f"https://n{k}.example/x", "s", w) for k, (x, w) in enumerate(zip(titles, when, strict=True))], ARTICLE)


def facts_of(spark, title):
    return ft.with_facts(articles(spark, [title])).first().facts


@pytest.mark.parametrize(
    ("title", "want"),
    [("Alpha raises $12.5 million", ["USD:12500000"]), ("알파 1,000억원 투자 유치", ["KRW:100000000000"]), ("Alpha gets KRW 3 billion", ["KRW:3000000000"]), ("Alpha pays 7 million dollars", ["USD:7000000"]), ("Alpha sells 30만 원", ["KRW:300000"]), ("none", [])],
)
def test_amounts(spark, title, want):
    assert facts_of(spark, title).amounts == want


@pytest.mark.parametrize(
    ("title", "want"),
    [("on 2026-07-21", ["2026-07-21"]), ("on Feb 30, 2026", []), ("on July 4, 2026", ["2026-07-04"]), ("2026년 7월 5일 발표", ["2026-07-05"]), ("20일 첫 시험비행", ["2026-07-20"]), ("5일 발표", [])],
)
def test_dates(spark, title, want):
    assert facts_of(spark, title).dates == want


def test_classes_and_parties(spark):
    f = facts_of(spark, "Alpha signs contract with Beta Corp and Gamma after merger")
    assert f.primary == ["contract"] and f.secondary == ["acquisition"] and f.milestones == ["signed"] and f.parties == ["beta corp", "gamma"]
    assert facts_of(spark, "로켓 시험 성공").actions == []
    assert facts_of(spark, "신약 시험 성공").actions == ["clinical_trial"]
    assert facts_of(spark, "grew 12.50% in 3").percentages == ["0.125"]


def test_marks_hide_no_match(spark):
    """Texts that differ from a mark in case; a long s makes no month."""
    f = facts_of(spark, "Alpha wins 7 PERCENT on \u017fep 5, 2026, MAY 6 2026")
    assert f.percentages == ["0.07"] and f.dates == ["2026-05-06"]
    assert facts_of(spark, "베타와 협력, Alpha와 계약").parties == sorted(facts_of(spark, "베타와 협력, Alpha와 계약").parties) != []


def test_a_pattern_is_tried_once(spark):
    """A fact that several columns read is worked out by one expression, and orders in one file are dealt out before."""
    plan = ft.with_facts(articles(spark, ["x"])).select("facts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_instr(") == 2 * len(ft.ACTIONS) + len(ft.MILESTONES) and plan.count("(20\\d{2})[-/.]") <= 4
    for was in [spark.conf.get("spark.sql.adaptive.enabled")]:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            assert views.headlines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", was)


def decide(spark, left, right, gap=0):
    start = datetime(2026, 7, 20, 9)
    rows = ft.with_facts(articles(spark, [left, right], [start, start + timedelta(hours=gap)])).withColumn("ord", F.col("id"))
    row = F.struct("ord", "id", "published_at", "title_key", "facts")
    a, b = rows.where("id = 'a000'").select("company", row.alias("l")), rows.where("id = 'a001'").select("company", row.alias("r"))
    got = cluster.decided(a.join(b, "company"), F.col("company")).first()
    return got.decision, got.reason


def test_ladder(spark):
    assert decide(spark, "Alpha raises $5 million", "Alpha raises $6 million") == ("DIFFERENT_EVENT", "amount_conflict")
    assert decide(spark, "Same title!", "same TITLE") == ("SAME_EVENT", "exact_normalized_title")
    assert decide(spark, "Same title", "Same title", gap=73) == ("DIFFERENT_EVENT", "publication_window_conflict")
    assert decide(spark, "Same title", "Same title", gap=72)[0] == "SAME_EVENT"
    assert decide(spark, "Alpha raises $5 million from Beta on 2026-07-20", "Beta funding of $5 million for Alpha from Beta") == ("SAME_EVENT", "multiple_canonical_identity_anchors")
    assert decide(spark, "Alpha news", "Alpha story")[0] == "AMBIGUOUS"
    assert decide(spark, "Alpha raises $5 million and $6 million", "Alpha raises $5 million")[1] == "partial_distinctive_anchor_mismatch"
    assert decide(spark, "Alpha opens Seoul plant on 2026-07-20", "Alpha closes Busan office on 2026-07-20")[0] == "DIFFERENT_EVENT"


def test_dedup_is_not_transitive(spark):
    rows = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2"), (4, "", ""), (5, "", "")], "seq long, url_key string, title_key string")
    assert {(r.seq, r.primary_seq, r.reason) for r in dedup.dedup_map(rows).collect()} == {(1, 1, None), (2, 1, "canonical_url"), (3, 3, None), (4, 4, None), (5, 5, None)}


def greedy(rows):
    taken, want = {}, {}
    for s, u, x in rows:
        by = taken.get(("u", u)) if u else None
        by = by if by is not None else (taken.get(("t", x)) if x else None)
        want[s] = s if by is None else by
        if by is None:
            taken.update({k: s for k in (("u", u), ("t", x)) if k[1]})
    return want


def test_dedup_of_long_chains_takes_few_rounds(spark, monkeypatch):
    """A chain in which every row shares one key with the row before it, by turns; and shuffled chains. Few tables are written, and only the result stays."""
    written = []
    monkeypatch.setattr(dedup, "stored", lambda df, name, f=dedup.stored: written.append(name) or f(df, name))
    chain = [(k, f"u{k // 2}", f"t{(k + 1) // 2}") for k in range(10_000)]
    order = list(range(10_000, 12_000))
    random.Random(1).shuffle(order)
    chain += sorted((s, f"v{k // 2}", f"w{(k + 1) // 2}") for k, s in enumerate(order))
    got = dedup.dedup_map(spark.createDataFrame(chain, "seq long, url_key string, title_key string").repartition(4))
    assert {m.seq: m.primary_seq for m in got.collect()} == greedy(chain)
    assert sum(n in ("dedup-stays", "dedup-chunk") for n in written) <= 20
    from pathlib import Path

    left = [p.name for p in Path(got.stored_at.removeprefix("file:")).parent.iterdir() if p.name.startswith(("dedup", "edges", "labels"))]
    assert Path(got.stored_at).name in left and not [n for n in left if n.startswith(("dedup-left", "dedup-stays", "dedup-chunk", "dedup-rows", "dedup-places", "edges"))]


@pytest.mark.parametrize(("seed", "rounds", "chunk"), [(1, 1, 3), (2, 2, 10), (3, 4, 100_000)])
def test_dedup_by_rounds_and_chunks(spark, seed, rounds, chunk):
    r = random.Random(seed)
    rows = [(k, f"u{r.randrange(60)}" if r.random() < 0.9 else "", f"t{r.randrange(60)}" if r.random() < 0.9 else None) for k in range(150)]
    df = spark.createDataFrame(rows, "seq long, url_key string, title_key string").orderBy(F.rand(3))
    assert {m.seq: m.primary_seq for m in dedup.dedup_map(df, rounds, chunk).collect()} == greedy(rows)


def test_dedup_of_nothing(spark):
    assert dedup.dedup_map(spark.createDataFrame([], "seq long, url_key string, title_key string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    rows = [(k, f"u{r.randrange(25)}" if r.random() < 0.9 else "", f"t{r.randrange(25)}" if r.random() < 0.9 else "") for k in range(80)]
    kept, want = [], {}
    for s, u, x in rows:
        by = next((k for k in kept if u and k[1] == u), None) or next((k for k in kept if x and k[2] == x), None)
        want[s] = by[0] if by else s
        if not by:
            kept.append((s, u, x))
    df = spark.createDataFrame(rows, "seq long, url_key string, title_key string").orderBy(F.rand(3))
    assert {m.seq: m.primary_seq for m in dedup.dedup_map(df).collect()} == want


def test_blocking_loses_no_pair_and_clusters_are_complete(spark):
    base = ["Alpha raises $5 million from Beta on 2026-07-20", "Funding: Alpha raises $5 million from Beta", "Alpha raises $5 million from Beta on 2026-07-20 now", "Alpha acquires Gamma for $9 million", "Alpha acquires Gamma for $9 million deal", "Other thing"]
    when = [datetime(2026, 7, 20, 9) + timedelta(hours=20 * k) for k in range(6)]
    rows = ft.with_facts(articles(spark, base, when)).withColumn("ord", F.col("id"))
    same = lambda p: {(x.l, x.r) for x in cluster.decided(p, F.col("company")).where("decision = 'SAME_EVENT'").select(F.col("l.id").alias("l"), F.col("r.id").alias("r")).collect()}
    blocked, full = same(cluster.pairs(rows, ["company"])), same(cluster.all_pairs(rows, ["company"]))
    assert blocked == full and full
    groups = {}
    for x in cluster.clustered(rows).collect():
        groups.setdefault(x.group, set()).add(x.id)
    assert sorted(len(g) for g in groups.values())[-1] >= 2 and sum(map(len, groups.values())) == 6
    for g in groups.values():
        assert all((a, b) in full for a in g for b in g if a < b)


def test_article_id_of_a_null_time(spark):
    df = spark.createDataFrame([("https://A.com", "T", None)], "u string, t string, ts timestamp")
    import hashlib

    assert df.select(t.article_id(F.col("u"), F.col("t"), F.col("ts"))).first()[0] == hashlib.sha256(b"https://a.com|t|None").hexdigest()[:16]


def test_words_end_as_unicode_has_it(spark):
    """Korean particles are letters: a percentage, date or number that one follows isn't told as such."""
    text = "매출 5%가 늘어 2026년 3월 5일에 3억 규모, 2026-03-05에 7%, 2026-03-06, 12 won짜리 15 won."
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(ft.percentages(F.col("x")).alias("p"), ft.dates(F.col("x"), F.lit(None).cast("timestamp")).alias("d"), ft.amounts(F.col("x")).alias("a")).first()
    assert got.p == ["0.07"] and got.d == ["2026-03-06"] and got.a == ["KRW:15"]
    row = ft.with_facts(spark.createDataFrame([("3억 규모 42 items", "", "")], "title string, description string, text string").withColumn("published_at", F.lit(None).cast("timestamp"))).first()
    assert row.facts.numbers == ["42"]


def test_title_ratio_and_its_bound(spark):
    """The ratio is that of the plain matcher wherever it can reach the threshold, at and around it; the bound is never below it, and lets few other pairs through."""
    from difflib import SequenceMatcher

    r = random.Random(9)
    letters = "abcdefghij 가나다"
    pairs = []
    for _ in range(600):
        a = "".join(r.choices(letters, k=r.randrange(1, 60)))
        b = list(a)
        for _ in range(r.randrange(0, 8)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choices(letters, k=r.randrange(2))
        pairs.append((a, "".join(b) if r.random() < 0.7 else "".join(r.sample(a, len(a)))))
    pairs += [("abcd" * 6 + "x", "abcd" * 6 + "y"), ("a" * 23 + "bb", "a" * 23 + "cc"), ("", ""), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", cluster.title_ratio(F.col("a"), F.col("b")).alias("ratio"), cluster.ratio_bound(F.col("a"), F.col("b")).alias("bound"))
    near = 0
    for x in df.collect():
        want = SequenceMatcher(None, x.a, x.b).ratio()
        assert x.bound >= want - 1e-12
        assert x.ratio == want if x.ratio is not None else want < cluster.RATIO
        near += abs(want - cluster.RATIO) < 0.03
    assert near > 20
    apart = [("".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=40)), "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=40))) for _ in range(300)]
    through = spark.createDataFrame(apart, "a string, b string").where(cluster.ratio_bound(F.col("a"), F.col("b")) >= cluster.RATIO).count()
    assert through == 0  # lengths alone would have sent all of them to Python


def test_a_frequent_party_makes_no_pairs(spark):
    """Two hundred rows name one party on one day, each with another amount; two are told twice. Only these meet, and all SAME pairs are among them."""
    titles = [f"Alpha acquires unit {k} with Beta Corp for ${k} million on 2026-07-21" for k in range(1, 201)]
    rows = ft.with_facts(articles(spark, titles + titles[:2])).withColumn("ord", F.col("id")).cache()
    assert cluster.likely_pairs(rows, ["company"]).count() == 2
    same = lambda met: {(x.a, x.b) for x in cluster.decided(met, F.col("company")).where("decision = 'SAME_EVENT'").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()}
    assert same(cluster.likely_pairs(rows, ["company"])) == same(cluster.all_pairs(rows, ["company"])) != set()


def test_components_share_a_call(spark, monkeypatch):
    """Many small components are settled by few calls of the Python function, with the same groups."""
    rows = spark.range(600).select("id", F.col("id").alias("ord"))
    same = spark.range(200).select((F.col("id") * 3).alias("l"), (F.col("id") * 3 + 1).alias("r")).union(spark.range(200).select((F.col("id") * 3 + 1).alias("l"), (F.col("id") * 3 + 2).alias("r")))
    for size in (50, 2000):
        monkeypatch.setattr(cluster, "CALL_ROWS", size)
        got = {x.id: x.group for x in cluster.greedy_groups(rows, same).collect()}
        assert got == {k: k - 1 if k % 3 == 1 else k for k in range(600)}


def test_a_user_function_gets_whole_chunks_together(spark):
    """Two hundred chunks of three rows reach the function in far fewer calls, none of them torn."""
    from eventloom.operators.verdicts import by_group_function

    def sizes(part):
        return part.groupby("k").size().reset_index(name="n").assign(call=lambda x: int(part["id"].min()))[["k", "n", "call"]]

    rows = spark.range(600).withColumn("k", F.col("id") % 200)
    got = by_group_function(rows, ["k"], sizes, "k long, n long, call long", call_rows=300).collect()
    assert len(got) == 200 and {x.n for x in got} == {3} and len({x.call for x in got}) <= 3
