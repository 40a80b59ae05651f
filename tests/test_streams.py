"""Streams over several batches: windows from the ledger, keyed dedup state that forgets, and clusters of a sliding window."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventloom.functions import facts as ft
from eventloom.operators import cluster
from eventloom.streaming import incremental, keyed, rolling
from tests.test_trail import ARTICLE, news


def test_a_failed_run_does_not_move_the_window(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    day = lambda k, hour=0: datetime(2026, 1, k, hour, tzinfo=timezone.utc)
    rows = [(k, day(1) + timedelta(hours=k)) for k in range(24 * 6)] + [(-1, None)]
    df = spark.createDataFrame([(k, None if t is None else t.timestamp()) for k, t in rows], "id long, at double").select("id", F.col("at").cast("timestamp").alias("published_at"))
    df.repartition(3).write.parquet(path("in"))
    seen = []

    def run(k, name, handle=None, mode="delivery"):
        stream = spark.readStream.schema(df.schema).parquet(path("in"))
        return incremental.incremental_run(stream, path("ledger"), path(f"out-{name}"), path(f"cp-{name}"), day(k), mode, handle=handle)

    def broken(batch, batch_id):
        raise RuntimeError("planted")

    def want(start, end):
        ts = [t for _, t in rows if t is not None]
        return {"accepted": sum(start <= t <= end for t in ts), "too_old": sum(t < start for t in ts), "future": sum(t > end for t in ts), "missing": 1}

    counts = lambda r: {c: r[c] for c in incremental.CLASSES}
    assert counts(run(2, "a", lambda b, i: seen.append(b.count()))) == want(day(2) - timedelta(hours=30), day(2))
    assert seen == [want(day(2) - timedelta(hours=30), day(2))["accepted"]]
    with pytest.raises(Exception, match="planted"):
        run(4, "b", broken)
    assert counts(run(5, "c")) == want(day(2) - timedelta(hours=2), day(5))
    assert counts(run(6, "d")) == want(day(5) - timedelta(hours=2), day(6))
    assert counts(run(6, "e", mode="shadow")) == want(day(6) - timedelta(hours=30), day(6))  # another mode has no success yet
    late = spark.read.parquet(path("out-d")).where("freshness = 'too_old'").count()
    assert late == want(day(5) - timedelta(hours=2), day(6))["too_old"]
    ledger = spark.read.parquet(path("ledger")).orderBy("at").collect()
    assert [(r.status, r.checkpoint is None) for r in ledger] == [("success", False), ("failed", True), ("success", False), ("success", False), ("success", False)]


def test_keyed_dedup_equals_the_loop_and_forgets(spark, tmp_path):
    """Eight batches, each a run of its own (so each restarts from the checkpoint): the loop keeps keys of rows that arrived within two days of the newest earlier one."""
    rng = random.Random(4)
    start, ttl = datetime(2026, 1, 1, tzinfo=timezone.utc), timedelta(days=2)
    batches, seq = [], 0
    for b in range(8):
        rows = []
        for _ in range(30):
            rows.append((seq, f"u{rng.randrange(40)}" if rng.random() < 0.9 else " ", f"t{rng.randrange(40)}" if rng.random() < 0.7 else None, start + timedelta(hours=12 * b, minutes=rng.randrange(600))))
            seq += 1
        batches.append(rows)
    kept, newest, want = [], None, []
    for rows in batches:
        known = [k for k in kept if newest is None or k[3] >= newest - ttl]
        for r in rows:
            key = [x.strip() if x else "" for x in r[1:3]]
            if not any((key[0] and key[0] == (k[1] or "").strip()) or (key[1] and key[1] == (k[2] or "").strip()) for k in known):
                known.append(r)
                kept.append(r)
                want.append(r[0])
        newest = max([r[3] for r in rows] + ([newest] if newest else []))
    shape = "seq long, url_key string, title_key string, at double"
    out, work, sizes = str(tmp_path / "out"), str(tmp_path / "work"), []
    for rows in batches:
        df = spark.createDataFrame([(*r[:3], r[3].timestamp()) for r in rows], shape).select("seq", "url_key", "title_key", F.col("at").cast("timestamp").alias("arrived"))
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        query = keyed.dedup_run(spark, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), out, work, "2 days")
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/*").collect()) == want
    assert len(want) > len({k for k in want if k < 120}) and max(sizes[4:]) < 2 * len(want)  # later rows are kept again, and the state doesn't hold them all
    assert sizes[-1] <= 80


@pytest.mark.parametrize("keep", [72])
def test_rolling_clusters_equal_the_window_clustered_anew(spark, tmp_path, keep):
    """Four batches in order of time, with overlaps, undated and late rows and repeated ids; then a batch that comes again."""
    rows = sorted(news(keep), key=lambda r: r[-1] or datetime(2026, 7, 24))
    df = ft.with_facts(spark.createDataFrame(rows, ARTICLE)).select(*rolling.ROW).cache()
    parts = [[r[0] for r in rows[a:b]] for a, b in ((0, 20), (18, 40), (40, 60), (55, 70))]
    late = rows[3][0]
    parts[3].append(late)
    handle = rolling.rolling_clusters(str(tmp_path / "state"), str(tmp_path / "out"), keep_hours=keep)
    batch = lambda ids: df.where(F.col("id").isin(ids))
    when = {r[0]: r[-1] for r in rows}
    seen, until, named = set(), {}, {}
    state = lambda: rolling.members(spark, str(tmp_path / "state"), df.schema).select("id", "group", "event_id").collect()
    for k, ids in enumerate(parts):
        handle(batch(ids), k)
        newest = max(x for i in seen | set(ids) if (x := when[i]) is not None)
        for i in ids:
            until.setdefault(i, (when[i] or newest) + timedelta(hours=keep))
        seen |= set(ids)
        live = [i for i in seen if until[i] >= newest]
        got = state()
        assert {r.id for r in got} == set(live)
        anew = {}
        for r in cluster.clustered(batch(live)).collect():
            anew.setdefault(r.group, set()).add(r.id)
        mine = {}
        for r in got:
            mine.setdefault(r.event_id, set()).add(r.id)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, anew.values()))
        kept = [e for e, ids_ in mine.items() if e in named and ids_ & named[e]]
        assert len(kept) >= len([e for e in named if any(named[e] <= x for x in mine.values())]) * 0.5
        for e, old in named.items():  # an event whose members are together still, alone with new ones, keeps its id
            home = [x for x in mine.values() if x & old]
            if len(home) == 1 and home[0] & seen <= old | (set(ids) - old) and not any(home[0] & other for f, other in named.items() if f != e):
                assert mine.get(e) == home[0]
        named = mine
    before = sorted(map(tuple, state()))
    handle(batch(parts[3]), 3)
    assert sorted(map(tuple, state())) == before
    said = spark.read.parquet(str(tmp_path / "out/batch=3")).where("status = 'late'").collect()
    assert [r.id for r in said] == [late]


def test_ledger_survives_a_crash_before_its_mark(spark, tmp_path, monkeypatch):
    """Batches of a hot kind; the second fails after its rows are written, comes again, and comes once more after it was committed."""
    from eventloom.streaming.state import Versions

    batches = [[("event", f"f{(b * 37 + k * 11) % 90}", k) for k in range(40)] + [("article", f"a{b}", 0), ("article", f"a{b}", 1)] for b in range(4)]
    want: dict[str, list[str]] = {"event": [], "article": []}
    for rows in batches:
        for kind, f, _ in sorted(rows, key=lambda r: r[2]):
            if f not in want[kind]:
                want[kind].append(f)
        want["event"] = want["event"][-50:]
    path = str(tmp_path / "ledger")
    mark = incremental.mark_sent(path, keep=50)
    frame = lambda b: spark.createDataFrame(batches[b], "kind string, fingerprint string, pos long").repartition(3)
    read = lambda: [tuple(r) for r in incremental.sent(spark, path).orderBy("kind", "seq").select("kind", "fingerprint").collect()]
    mark(frame(0), 0)
    before = read()
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        mark(frame(1), 1)
    assert read() == before
    monkeypatch.setattr(Versions, "commit", commit)
    for b in (1, 1, 2, 3, 2):
        mark(frame(b), b)
    assert read() == [(kind, f) for kind in ("article", "event") for f in want[kind]]
    assert len(Versions(spark, path).committed()) == 2
