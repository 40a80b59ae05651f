"""Run-quality aggregates and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.order import summed


def feed_metrics(outcomes: DataFrame) -> DataFrame:
    """outcomes(status, http_status, retry_attempts, optionally retry_after_used) -> one row. A missed deadline of the collection is a timeout."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "success")
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    waited = F.col("retry_after_used") if "retry_after_used" in outcomes.columns else F.lit(0)
    return outcomes.agg(
        n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("success_ratio"), of("rate_limited").alias("rate_limited"), of("service_unavailable").alias("unavailable"),
        F.count_if((F.col("status") == "http_error") & F.col("http_status").between(500, 599)).alias("other_5xx"), of("timeout", "collection_deadline").alias("timeouts"), of("connection_error").alias("connection_errors"),
        of("parse_error").alias("parse_errors"), of("skipped_systemic_failure").alias("skipped"), F.coalesce(F.sum("retry_attempts"), F.lit(0)).alias("retries"), F.coalesce(F.sum(waited), F.lit(0)).cast("long").alias("retry_after_used"),
    )


def coverage_gate(outcomes: DataFrame, threshold: float = 0.90, zero_news: float = 0.98) -> DataFrame:
    """Is the share of successful queries sufficient, and sufficient to believe in no news; no query at all is an error."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    m = outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"))
    m = m.withColumn("ratio", F.when(F.col("total") == 0, F.raise_error(F.lit("no query was asked")).cast("double")).otherwise(F.col("succeeded") / F.col("total")))
    return m.withColumn("sufficient", F.col("ratio") >= threshold).withColumn("zero_news_healthy", F.col("ratio") >= zero_news)


def latencies(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50 is element (n-1) div 2, p95 element min(n-1, int(0.95 n)), counted from 0, of the sorted values; 2 decimals, 0 where there is none.

    Counts of distinct values (pre-aggregated) are summed over a range shuffle by group and value, so a group of any size lies over many tasks; its sought elements are places in that order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = summed(counts, [*(F.col(c) for c in by), F.col(value)], "n", "upto")
    named = {c: f"__{k}" for k, c in enumerate(by)}  # a group's columns on the other side of a join, where nulls meet nulls
    met = lambda left, right: left.join(right, [F.equal_null(F.col(c), F.col(n)) for c, n in named.items()], "left").drop(*named.values())
    ends = run.groupBy(*by).agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.max("upto").alias("stop"), F.max(value).alias("max"))
    total = F.col("stop") - F.col("start")
    sought = ends.select(*(F.col(c).alias(n) for c, n in named.items()), "max", (F.col("start") + F.floor((total - 1) / 2)).alias("half"), (F.col("start") + F.least(total - 1, F.floor(total * 0.95))).alias("most"))
    at = lambda k: F.max(F.when((F.col("upto") > F.col(k)) & (F.col("upto") - F.col("n") <= F.col(k)), F.col(value)))
    got = met(run, sought).groupBy(*by).agg(at("half").alias("p50"), at("most").alias("p95"), F.max("max").alias("max"))
    every = met(rows.select(*by).distinct(), got.select(*(F.col(c).alias(n) for c, n in named.items()), "p50", "p95", "max"))
    return every.select(*by, *(F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("p50", "p95", "max")))


def stage_rates(rows: DataFrame, candidates: int) -> DataFrame:
    """rows(stage, outcome, retries, latency_ms, input_tokens, cached_tokens, output_tokens, reasoning_tokens), a row a request; outcome: accept, reject, escalate, or why it failed: rate_limit, timeout, server_error,
    schema_failure, client_error -> for each stage its counts, latencies (I5) and tokens, the share of all candidates that it resolved and the share that reached it (5 decimals)."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    failures = {"rate_limit": "rate_limits", "timeout": "timeouts", "server_error": "server_errors", "schema_failure": "schema_failures"}
    tokens = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens")
    g = rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("requests"), of("accept").alias("accepts"), of("reject").alias("rejects"), of("escalate").alias("escalates"), F.count_if(F.col("outcome").isin(*failures, "client_error")).alias("failures"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), *(of(k).alias(v) for k, v in failures.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens),
    )
    share = lambda c: F.round(c / max(candidates, 1), 5)
    g = g.withColumn("resolution_rate", share(F.col("accepts") + F.col("rejects"))).withColumn("reached_rate", share(F.col("requests")))
    return g.join(latencies(rows, "latency_ms", ["stage"]), "stage")


def stage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(stage, input_tokens, cached_tokens, output_tokens), prices(stage, input, cached, output per million) -> totals and cost; cost is null without a price, a partly
    given price is an error."""
    some = sum(((F.col(c).isNotNull()).cast("int") for c in ("input", "cached", "output")), F.lit(0))
    u = usage.groupBy("stage").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens"))).join(prices, "stage", "left")
    cost = ((F.col("input_tokens") - F.col("cached_tokens")) * F.col("input") + F.col("cached_tokens") * F.col("cached") + F.col("output_tokens") * F.col("output")) / 1e6
    return u.withColumn("cost", F.when(some.isin(1, 2), F.raise_error(F.lit("partial price")).cast("double")).otherwise(F.round(cost, 8))).drop("input", "cached", "output")


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """I4, I8, I10, I17."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def identity_audit(verdicts: DataFrame, reason: Column) -> DataFrame:
    """verdicts(batch_id, id, verdict) -> (company_id, id, verdict, reason_code); a verdict without a reason says so."""
    return verdicts.select(F.col("batch_id").alias("company_id"), "id", "verdict", F.coalesce(reason, F.lit("provider_no_audit")).alias("reason_code"))


def funnel(companies: DataFrame, rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counts per company, with rows of zeros for silent ones."""
    g = rows.groupBy("company_id").agg(*(F.count_if(c).alias(k) for k, c in flags.items()))
    return companies.select("company_id").join(g, "company_id", "left").fillna(0, list(flags))


def systemic_failure(rows: DataFrame, failed: Column, least: int = 3, ratio: float = 0.25) -> DataFrame:
    """At least `least` failures that are at least `ratio` of the rows; nothing is no failure."""
    m = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures"))
    return m.withColumn("systemic", (F.col("failures") >= least) & (F.coalesce(F.try_divide("failures", "total"), F.lit(0.0)) >= ratio))


def decision_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """old(candidate_id, accept), new(candidate_id, accept, tier) -> confusion counts by tier."""
    met = old.select("candidate_id", F.col("accept").alias("old")).join(new.select("candidate_id", F.col("accept").alias("new"), "tier"), "candidate_id")
    c = lambda a, b, name: F.count_if((F.col("old") == a) & (F.col("new") == b)).alias(name)
    return met.groupBy("tier").agg(c(True, True, "both"), c(True, False, "lost"), c(False, True, "gained"), c(False, False, "neither"))


def _replayed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("candidate_id", F.col("accept").alias("_old")).join(new, "candidate_id")


def replay_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """old(candidate_id, accept), new(candidate_id, accept, tier1: ACCEPT, REJECT or anything else, tier2 boolean: it was asked, failed boolean: accepted because it failed) -> one row of all counts and rates."""
    n, asked, failed = F.count(F.lit(1)), F.coalesce(F.col("tier2"), F.lit(False)), F.coalesce(F.col("failed"), F.lit(False))
    first = lambda name: F.col("tier1").eqNullSafe(F.lit(name))
    settled = F.count_if(first("ACCEPT") | first("REJECT"))
    share = lambda c: F.round(c / F.greatest(n, F.lit(1)), 5)
    return _replayed(old, new).agg(
        n.alias("candidates"), F.count_if("_old").alias("old_accept"), F.count_if(~F.col("_old")).alias("old_reject"), F.count_if(first("ACCEPT")).alias("tier1_accept"), F.count_if(first("REJECT")).alias("tier1_reject"),
        (n - settled).alias("tier1_escalate"), F.count_if(asked).alias("tier2_calls"), F.count_if(asked & F.col("accept") & ~failed).alias("tier2_accept"), F.count_if(asked & ~F.col("accept")).alias("tier2_reject"), F.count_if(failed).alias("failure_accept"),
        F.count_if("accept").alias("new_accept"), F.count_if(~F.col("accept")).alias("new_reject"), F.count_if(F.col("_old") & ~F.col("accept")).alias("lost"), F.count_if(~F.col("_old") & F.col("accept")).alias("gained"),
        share(settled).alias("resolution_rate"), share(F.count_if(asked)).alias("escalation_rate"),
    )


def replay_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """new's rows whose decision isn't the old one, with `change`: lost or gained."""
    met = _replayed(old, new).where("_old <> accept")
    return met.withColumn("change", F.when(F.col("_old"), "lost").otherwise("gained")).drop("_old")


#: What an editorial run counts, by the event that its trace tells.
EDITORIAL = {
    "call": ("summary_calls",), "validation_retry": ("summary_retries", "summary_evidence_retries"), "failure": ("summary_failures",), "implication": ("insight_implication_count",), "watchpoint": ("insight_watchpoint_count",),
    "grounding_call": ("grounding_verifier_calls",), "grounding_failure": ("grounding_verifier_failures",), "unsupported_implication": ("unsupported_implications",), "watchpoint_rewrite": ("watchpoint_rewrites",),
    "watchpoint_fallback": ("watchpoint_fallbacks",), "core_rewrite": ("core_rewrites",), "core_fallback": ("core_fallbacks",),
}


def editorial_counters(trace: DataFrame) -> DataFrame:
    """trace(event) -> one row with the thirteen counters."""
    return trace.agg(*(F.count_if(F.col("event") == e).alias(name) for e, names in EDITORIAL.items() for name in names))


def column_profile(df: DataFrame, columns: list[str], low: int = 20, high: int = 1000) -> DataFrame:
    """Per column nonblank count, distinct share and whether it may be the name column (count within low..high); one pass, one row per column."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    one = df.agg(*(F.struct(F.count(blank(c)).alias("nonblank"), F.count_distinct(blank(c)).alias("distinct")).alias(c) for c in columns))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.nonblank"), F.col(f"{c}.distinct")) for c in columns))).alias("x")).select("x.*")
    return long.withColumn("unique_ratio", F.round(F.coalesce(F.try_divide("distinct", "nonblank"), F.lit(0.0)), 6)).withColumn("eligible", F.col("nonblank").between(low, high))


def progress(stage_events: DataFrame) -> DataFrame:
    """I16: stage_events(stage, status, item, ts) -> counters and the last item."""
    return stage_events.groupBy("stage").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("started", "completed", "failed")), F.max_by("item", F.struct("ts", "item")).alias("last_item"))


def rolling_failure(outcomes: DataFrame, by: list[str], order: list[str], window: int = 6, share: float = 0.8) -> DataFrame:
    """outcomes(transient, ...) with `alarm`: a full window of the last outcomes whose transient share is at least `share`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    r = outcomes.withColumn("transient_share", F.round(F.avg(F.col("transient").cast("double")).over(w), 6)).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.withColumn("alarm", (F.col("_n") == window) & (F.col("transient_share") >= share)).drop("_n")
