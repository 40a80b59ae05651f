"""The trail of compared pairs against the plain loop: every list and every counter."""

import random
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import facts as ft
from eventloom.functions.facts import GENERIC
from eventloom.operators import cluster, order, trail

ARTICLE = "id string, company string, title string, description string, text string, url string, source string, published_at timestamp"


@pytest.mark.parametrize("seed", range(4))
def test_greater_before(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 7, 64, 65, 200):
        v = rng.integers(0, 30, n)
        assert order.greater_before(v).tolist() == [int((v[:k] > v[k]).sum()) for k in range(n)]


def test_discordant_pairs(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.randrange(12)) for s, n in (("a", 90), ("b", 1), ("c", 40)) for k in range(n)]
    want = Counter()
    for x in rows:
        want[x[0]] += sum(y[0] == x[0] and y[1] < x[1] and y[2] > x[2] for y in rows)
    got = {r.s: r.n for r in order.discordant(spark.createDataFrame(rows, "s string, a long, b long").repartition(3), "s", "a", "b").collect()}
    assert {k: got.get(k, 0) for k in "abc"} == {k: want[k] for k in "abc"}
    assert order.discordant(spark.createDataFrame([], "s string, a long, b long"), "s", "a", "b").count() == 0


def news(seed):
    """Rows of four companies (one has most): tellings with and without facts, far and near in time, some undated."""
    rng = random.Random(seed)
    start = datetime(2026, 7, 20, 9)
    make = [
        lambda: f"Alpha raises ${rng.randrange(5, 7)} million from Beta on 2026-07-2{rng.randrange(2)}", lambda: f"Alpha raises $5 million from Beta on 2026-07-20 {'now' * rng.randrange(2)}", lambda: rng.choice(["Plain news", "plain NEWS", "Other story", "Third thing"]),
        lambda: f"Alpha acquires Gamma for ${rng.choice(['9', '9', '8'])} million", lambda: f"Alpha opens {rng.choice(['Seoul', 'Busan'])} plant on 2026-07-20", lambda: "Alpha raises $5 million and $6 million",
    ]
    out = []
    for k in range(70):
        when = None if rng.random() < 0.1 else start + timedelta(hours=rng.randrange(200))
        out.append((f"a{k:03d}", rng.choice(["Alpha", "Alpha", "Alpha", "Beta", "beta", "C"]), rng.choice(make)(), None, None, f"https://n{rng.randrange(40)}.example/x", "s", when))
    return out


def decide(a, b, company, hours=72):
    """The ladder on two rows with facts."""
    if a.published_at and b.published_at and abs(a.published_at - b.published_at) > timedelta(hours=hours):
        return "DIFFERENT_EVENT", "publication_window_conflict"
    x, y = a.facts, b.facts
    names = {"amounts": "amount", "percentages": "percentage", "parties": "counterparty", "primary": "action", "milestones": "milestone", "dates": "explicit_date", "families": "event_family"}
    for k, name in names.items():
        if x[k] and y[k] and not set(x[k]) & set(y[k]):
            return "DIFFERENT_EVENT", f"{name}_conflict"
    if a.title_key == b.title_key:
        return "SAME_EVENT", "exact_normalized_title"
    own = set((company or "").casefold().split())
    named = [{t for t in f["subjects"] if len(t) > 1 and t not in GENERIC and t not in own} for f in (x, y)]
    if company and x["dates"] and x["dates"] == y["dates"] and named[0] and named[1] and not named[0] & named[1]:
        return "DIFFERENT_EVENT", "named_subject_conflict_on_shared_date"
    if any(x[k] and y[k] and x[k] != y[k] for k in ("amounts", "percentages", "parties", "primary", "milestones", "dates")):
        return "AMBIGUOUS", "partial_distinctive_anchor_mismatch"
    same = [k for k in ("amounts", "percentages", "parties", "dates") if x[k] and x[k] == y[k]]
    subject = set(x["subjects"]) & set(y["subjects"])
    action = x["primary"] and x["primary"] == y["primary"]
    if same and subject and SequenceMatcher(None, a.title_key, b.title_key).ratio() >= 0.92:
        return "SAME_EVENT", "high_title_similarity_with_distinctive_anchor"
    if len(same) >= 2 and action and subject:
        return "SAME_EVENT", "multiple_canonical_identity_anchors"
    if same and action and x["milestones"] and x["milestones"] == y["milestones"] and subject:
        return "SAME_EVENT", "canonical_identity_action_milestone_combination"
    if company and "dates" in same and named[0] & named[1]:
        return "SAME_EVENT", "shared_scheduled_date_and_named_subject"
    return "AMBIGUOUS", "insufficient_distinctive_event_identity"


def loop(rows, verdicts, scoped=True):
    """(groups, trail) as a plain loop makes them; rows in order."""
    groups, out = [], []
    for r in rows:
        for members in groups:
            if scoped and members[0].company != r.company:
                continue
            said = []
            for s in members:
                d, why = decide(s, r, r.company if scoped else None)
                final = d
                if d == "AMBIGUOUS" and verdicts is not None:
                    final = verdicts.get(frozenset((s.id, r.id)), "DIFFERENT_EVENT")
                said.append((s.id, r.id, d, why, final))
            out += said
            if all(x[-1] == "SAME_EVENT" for x in said):
                members.append(r)
                break
        else:
            groups.append([r])
    return groups, out


@pytest.mark.parametrize(("seed", "scoped", "judged", "block"), [(1, True, False, 512), (2, True, True, 16), (3, False, False, 7)])
def test_trail_equals_the_loop(spark, monkeypatch, seed, scoped, judged, block):
    monkeypatch.setattr(trail, "BLOCK", block)
    df = ft.with_facts(spark.createDataFrame(news(seed), ARTICLE)).withColumn("ord", F.struct(F.lower("company").alias("c"), F.col("published_at").isNull().alias("n"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), F.lower("url").alias("u"), F.col("id").alias("i")))
    if not scoped:
        df = df.withColumn("ord", F.struct(F.col("published_at").isNull().alias("n"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), F.col("id").alias("i")))
    df = df.cache()
    rows = df.orderBy("ord").collect()
    rng = random.Random(seed)
    told = [(a.id, b.id, rng.choice(["SAME_EVENT", "SAME_EVENT", "DIFFERENT_EVENT", "FAILED"])) for a in rows for b in rows if a.id < b.id and rng.random() < 0.3]
    table = spark.createDataFrame(told, "left_id string, right_id string, verdict string") if judged else None
    groups, want = loop(rows, {frozenset(x[:2]): "SAME_EVENT" if x[2] == "SAME_EVENT" else "DIFFERENT_EVENT" for x in told} if judged else None, scoped)
    scope, company = (["company"], F.col("company")) if scoped else ([], None)
    made = cluster.greedy_groups(df, cluster.same_pairs(df, scope, company, 72, table)).cache()
    assert {(r.id, r.group) for r in made.collect()} == {(x.id, g[0].id) for g in groups for x in g}
    listed = trail.trail(df, made, scoped, verdicts=table).collect()
    assert sorted((r.left_id, r.right_id, r.decision, r.reason, r.final_decision) for r in listed) == sorted(want)
    home = {x.id: g[0].id for g in groups for x in g}
    assert all(r.group == home[r.right_id] for r in listed)
    near = trail.trail(df, made, scoped, verdicts=table, beyond=False).collect()
    assert sorted((r.left_id, r.right_id, r.reason) for r in near) == sorted((x[0], x[1], x[3]) for x in want if x[3] != "publication_window_conflict")
    by_id, counts = {r.id: r for r in rows}, {}
    answered = {frozenset(x[:2]) for x in told if x[2] != "FAILED"} if judged else set()
    for a, b, d, why, _ in want:
        c = counts.setdefault(by_id[b].company if scoped else "", Counter())
        c.update(["compared", d] + (["beyond"] if why == "publication_window_conflict" else []) + (["failed"] if judged and d == "AMBIGUOUS" and frozenset((a, b)) not in answered else []))
    got = {r.scope: r for r in trail.pair_counters(df, made, scoped, verdicts=table).collect()}
    assert {d for c in counts.values() for d in c} >= {"SAME_EVENT", "DIFFERENT_EVENT", "AMBIGUOUS", "beyond"}
    for s, r in got.items():
        c = counts.get(s, Counter())
        calls = c["AMBIGUOUS"] if judged else 0
        assert (r.compared, r.beyond_window, r.same, r.different, r.ambiguous, r.resolver_calls, r.resolver_failures) == (c["compared"], c["beyond"], c["SAME_EVENT"], c["DIFFERENT_EVENT"], c["AMBIGUOUS"], calls, c["failed"]), s
    assert set(got) == {r.company if scoped else "" for r in rows}


def test_counters_of_nothing(spark):
    df = ft.with_facts(spark.createDataFrame([], ARTICLE)).withColumn("ord", F.col("id"))
    groups = spark.createDataFrame([], "id string, `group` string")
    assert trail.pair_counters(df, groups).count() == 0 and trail.trail(df, groups).count() == 0
