"""Queries for decision tables, cost, funnel, reports and streaming."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from eventloom.functions import facts as ft
from eventloom.operators import metrics, verdicts
from eventloom.plans.events import FACTS as _FACTS
from eventloom.sources import io, views
from eventloom.sources.shared import shared_dir, stored
from eventloom.sources.views import table
from eventloom.streaming import incremental, keyed, rolling

Q = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT user_id AS batch_id, event_id AS id, CASE WHEN user_id % 4 = 0 THEN 'UNCERTAIN' ELSE event_type END AS verdict FROM events")
def op_l1_batch_verdicts(spark, d):
    """Every fourth batch lacks the answer for its largest id, or (if it has one id) has it twice."""
    e = table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("id"), F.col("event_type").alias("verdict"))
    top = e.groupBy("batch_id").agg(F.max("id").alias("id"))
    got = e.join(top.where("batch_id % 4 = 0"), ["batch_id", "id"], "left_anti")
    return verdicts.batch_verdicts(e.select("batch_id", "id"), got)


def _partition(spark, d):
    o = table(spark, d, "orders")
    cand = o.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))
    g = o.groupBy(F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("group_no")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    rep = F.when(F.col("company") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.element_at("members", 1))
    return cand, g.withColumn("representative", rep).withColumn("label", F.when(F.col("company") % 3 == 1, F.lit(" ")).otherwise(F.col("group_no")))


@query("SELECT o_custkey AS company, o_custkey % 3 = 2 AS valid FROM orders GROUP BY 1")
def op_l2_partition_validity(spark, d):
    """A third of the companies names a stranger as representative, a third has blank labels."""
    return verdicts.partition_validity(*_partition(spark, d))


@query("SELECT o_custkey AS company, count(*) AS members, arg_min(o_orderstatus, o_orderkey) AS label FROM orders WHERE o_custkey % 3 = 2 GROUP BY o_custkey, o_orderstatus UNION ALL SELECT o_custkey, 1, 'order ' || o_orderkey FROM orders WHERE o_custkey % 3 <> 2")
def op_l3_partition_fallback(spark, d):
    return verdicts.with_fallback(*_partition(spark, d)).select("company", F.size("members").cast("long").alias("members"), "label")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 AND g > 1 THEN 'all' ELSE o_orderpriority END AS group_id FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS g FROM orders GROUP BY 1) USING (o_custkey)")
def op_l4_merged_partitions(spark, d):
    """Pass 1 merges every group of even companies; for odd ones it is incomplete, so their first level stays. Pass 2 reduces nothing."""
    o = table(spark, d, "orders")
    first = o.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("group_id"))
    groups = first.select("company", "group_id").distinct()
    one = groups.where("company % 2 = 0").select("company", "group_id", F.lit("all").alias("merged_id"))
    two = groups.select("company").distinct().select("company", F.lit("all").alias("group_id"), F.lit("all").alias("merged_id"))
    return verdicts.merged_partitions(first, [one, two]).select("id", "group_id")


@query("WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey AS company, max(CASE WHEN k = 1 THEN 'order ' || o_orderkey END) AS title, count(*) FILTER (k IN (2, 3)) AS more FROM x GROUP BY 1")
def op_l5_compressed(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    m = o.select(F.col("o_custkey").alias("company"), F.lit("g").alias("group_id"), F.lit("label").alias("label"), "rank", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))
    return verdicts.compressed(m).select("company", "title", F.size("more").cast("long").alias("more"))


def _assessed(spark, d):
    o = table(spark, d, "orders")
    events = o.select(F.col("o_orderkey").alias("event_id"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("member_ids"))
    k = F.col("o_orderkey") % 10
    v = o.where(k != 0).select(
        F.col("o_orderkey").alias("event_id"), F.when(k.isin(5, 7), "IGNORE").otherwise("DELIVER").alias("action"), F.when(k == 6, "low").when(k == 3, "medium").when(k.isin(4, 5, 7), "none").otherwise("high").alias("materiality"),
        F.when(~k.isin(5, 7), F.lit("a fact")).alias("fact"), F.when(k.isin(7, 8), F.lit("an insight")).alias("insight"),
        F.when(k == 2, F.array(F.col("o_orderkey") + 9)).when(k == 9, F.array_repeat("o_orderkey", 5)).otherwise(F.array("o_orderkey")).alias("evidence_ids"))
    return events, v


@query("SELECT o_orderkey AS event_id, CASE WHEN k IN (1, 3, 8) THEN 'DELIVER' ELSE 'IGNORE' END AS action, CASE WHEN k IN (0, 4, 6, 7, 9) THEN 'model_assessment_failure' WHEN k = 2 THEN 'invalid_evidence_id' END AS reason, CASE k WHEN 4 THEN 'incomplete_deliver' WHEN 6 THEN 'unknown_value' WHEN 7 THEN 'text_on_ignore' WHEN 9 THEN 'too_long' END AS violation, CASE WHEN k = 8 THEN 'an insight' END AS insight FROM (SELECT *, o_orderkey % 10 AS k FROM orders)")
def op_l6_assessments(spark, d):
    """Kinds of verdict by order: none, good, foreign evidence, good, without materiality, ignored, of an unknown materiality, ignored with an insight, good with one, with too much evidence."""
    return verdicts.assessed(*_assessed(spark, d)).select("event_id", "action", "reason", "violation", "insight")


@query("SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 10 IN (1, 3, 8)")
def op_d9_delivered(spark, d):
    return verdicts.assessed(*_assessed(spark, d)).where("action = 'DELIVER'").select("event_id")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'fact' ELSE o_orderpriority END AS fact, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 2 THEN 'insight' END AS insight FROM orders WHERE o_orderkey % 5 <> 0")
def op_l9_grounding(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("event_id"), F.lit("fact").alias("fact"), F.lit("insight").alias("insight"), F.col("o_orderpriority").alias("title"), F.array("o_orderkey").alias("member_ids"))
    v = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 3 != 1).alias("fact_ok"), (F.col("o_orderkey") % 2 == 0).alias("insight_ok"), F.when(F.col("o_orderkey") % 3 == 2, F.array(F.lit(-5).cast("long"))).otherwise(F.array("o_orderkey")).alias("evidence_ids"))
    return verdicts.grounded(items, v)


@query("SELECT o_orderkey AS candidate_id, [NULL, 'identity_changed', 'family_not_allowed', 'missing_materiality', 'reason_on_accept', NULL, 'value_on_reject', 'missing_reason', 'value_on_reject'][o_orderkey % 9 + 1] AS violation FROM orders")
def op_l10_contract(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 9
    c = o.select(F.col("o_orderkey").alias("candidate_id"), F.lit("c").alias("company"), F.lit("x").alias("exposure_id"), F.array(F.lit("supply"), F.lit("price")).alias("families"))
    dec = o.select(
        F.col("o_orderkey").alias("candidate_id"), F.when(k == 1, "other").otherwise("c").alias("company"), F.lit("x").alias("exposure_id"), (k <= 4).alias("qualifies"), F.when(k == 2, "weather").when((k <= 4) | (k == 6), "supply").otherwise("none").alias("family"),
        F.when(k == 3, "none").when(k <= 4, "high").otherwise("none").alias("materiality"), F.when(k.isin(4, 5, 6, 8), "weak_link").otherwise("none").alias("reason"), F.when((k <= 4) | (k == 8), "positive").otherwise("neutral").alias("direction"))
    return verdicts.contract_violations(c, dec).select("candidate_id", "violation")


#: One code of each kind: every direction, materiality and reject code, a family that isn't allowed, and codes that nothing settles.
CODES = (
    *(f"MATERIAL_LINK|{family}|{level}|{direction}" for family, level, direction in (("price", "high", "positive"), ("supply", "medium", "negative"), ("price", "low", "mixed"), ("supply", "high", "neutral"), ("weather", "high", "mixed"))),
    *verdicts.REJECT_REASONS, "AMBIGUOUS", "MATERIAL_LINK|price|high|unclear", "WEAK_LINK",
)


def _codes(spark, d):
    """Tier 1 by event_id modulo 15, tier 2 (not there for every fourth event) modulo 15 of a third of the id."""
    e = table(spark, d, "events").select(F.col("event_id").alias("candidate_id"))
    code = lambda k: F.element_at(F.array(*map(F.lit, CODES)), (k % len(CODES) + 1).cast("int"))
    cand = e.select("candidate_id", F.array(F.lit("supply"), F.lit("price")).alias("families"))
    return cand, e.select("candidate_id", code(F.col("candidate_id")).alias("code")), e.where("candidate_id % 4 <> 3").select("candidate_id", code(F.expr("candidate_id div 3")).alias("code"))


_CODES = """WITH c AS (SELECT event_id AS candidate_id, [('price', 'high', 'positive', NULL), ('supply', 'medium', 'negative', NULL), ('price', 'low', 'mixed', NULL), ('supply', 'high', 'neutral', NULL), NULL,
  (NULL, NULL, NULL, 'broad_industry_only'), (NULL, NULL, NULL, 'wrong_context'), (NULL, NULL, NULL, 'non_material'), (NULL, NULL, NULL, 'wrong_jurisdiction'), (NULL, NULL, NULL, 'weak_causal_link'), (NULL, NULL, NULL, 'duplicate_event'), (NULL, NULL, NULL, 'weak_causal_link'), NULL, NULL, NULL] AS says, event_id % 15 + 1 AS k1, CASE WHEN event_id % 4 <> 3 THEN event_id // 3 % 15 + 1 END AS k2 FROM events),
t AS (SELECT candidate_id, coalesce(says[k1], says[k2]) AS x, CASE WHEN says[k1] IS NOT NULL THEN 'tier1' WHEN says[k2] IS NOT NULL THEN 'tier2' END AS who, says[k1] AS one FROM c)"""


@query(f"{_CODES} SELECT candidate_id AS event_id, one[1] AS family, one[2] AS materiality, one[3] AS direction FROM t")
def op_l11_accept_codes(spark, d):
    """All levels and directions, and codes that aren't accepted."""
    p = verdicts.accept_parts(F.col("code"), F.array(F.lit("supply"), F.lit("price")))
    return _codes(spark, d)[1].select(F.col("candidate_id").alias("event_id"), p["family"].alias("family"), p["materiality"].alias("materiality"), p["direction"].alias("direction"))


@query(f"{_CODES} SELECT candidate_id AS event_id, one[4] AS reason FROM t")
def op_l12_reject_codes(spark, d):
    """All reject codes."""
    return _codes(spark, d)[1].select(F.col("candidate_id").alias("event_id"), verdicts.reject_reason(F.col("code")).alias("reason"))


@query(f"{_CODES} SELECT candidate_id, who IS NULL OR x[4] IS NULL AS qualifies, CASE WHEN who IS NULL THEN 'supply' ELSE x[1] END AS family, CASE WHEN who IS NULL THEN 'low' ELSE x[2] END AS materiality, CASE WHEN who IS NULL THEN 'neutral' ELSE x[3] END AS direction, x[4] AS reason, coalesce(who, 'conservative') AS decided_by FROM t")
def op_l13_two_tier(spark, d):
    return verdicts.two_tier(*_codes(spark, d))


@query(f"{_CODES} SELECT candidate_id, who IS NOT NULL AND x[4] IS NULL AS qualifies, CASE WHEN who IS NULL THEN 'unresolved' ELSE x[4] END AS reason FROM t")
def op_l14_legacy_tiers(spark, d):
    return verdicts.two_tier(*_codes(spark, d), on_unresolved="reject").select("candidate_id", "qualifies", "reason")


@query("SELECT o_orderkey, [NULL, 'external_needs_why', 'direct_has_why', 'evidence_missing', 'evidence_repeated', 'evidence_unknown', 'filler', NULL][o_orderkey % 8 + 1] AS error FROM orders")
def op_l15_summary_checks(spark, d):
    """L15, L19; every filler phrase in turn, in a watchpoint (an error) and in an implication (none)."""
    from eventloom.functions.text import FILLER

    k = F.col("o_orderkey") % 8
    phrase = F.element_at(F.array(*map(F.lit, FILLER)), (F.expr("o_orderkey div 8") % len(FILLER) + 1).cast("int"))
    key = F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    err = verdicts.summary_error(
        F.when(k == 2, "direct").otherwise("external"), F.when(k == 1, F.lit(None)).otherwise(F.lit("why")), F.when(k == 3, none).when(k == 4, F.array(key, key)).when(k == 5, F.array(key + 1)).otherwise(F.array(key)), F.array(key), F.when(k == 7, "implication").otherwise("watchpoint"), F.when(k.isin(6, 7), F.concat(F.lit("이번 계약은  "), phrase)).otherwise(F.lit("계약 이행 확인")))
    return table(spark, d, "orders").select("o_orderkey", err.alias("error"))


_MARKS = ", ".join(f"'{x}'" for x in (*verdicts.WATCHPOINTS.values(), verdicts.OTHER_WATCHPOINT))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '{verdicts.NO_TITLE}' ELSE c_name END AS fact, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN '{verdicts.NO_MECHANISM}' ELSE o_orderpriority END END AS mechanism, [{_MARKS}][o_orderkey % 6 + 1] AS watchpoint FROM orders JOIN customer ON o_custkey = c_custkey")
def op_l16_safe_summary(spark, d):
    """Every dimension with a template and one without; titles and mechanisms that are missing."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    dim = F.element_at(F.array(*map(F.lit, (*verdicts.WATCHPOINTS, "strategy"))), (key % 6 + 1).cast("int"))
    said = verdicts.safe_summary(F.when(key % 7 == 0, F.lit(" ")).otherwise(F.col("c_name")), F.when(key % 8 != 0, F.col("o_orderpriority")), dim, F.when(key % 2 == 0, "external").otherwise("direct"))
    return o.select("o_orderkey", said.alias("s")).select("o_orderkey", "s.*")


@query(f"SELECT o_orderkey, o_orderkey % 10 < 9 AS filler FROM orders")
def op_d8_filler(spark, d):
    """Every filler phrase, and a sentence without one."""
    from eventloom.functions.text import FILLER, has_filler

    said = F.element_at(F.array(*(F.lit(f"앞으로 {p}.") for p in FILLER), F.lit("계약 이행을 확인.")), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", has_filler(said).alias("filler"))


def _evidence(spark, d):
    """Line items as members of their order's event, in order; every fourth order is external, with its items' suppliers as links."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    m = li.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    word = lambda c: F.array(F.concat(F.lit(c[2]), F.col(c).cast("string")))
    none = F.array().cast("array<string>")
    facts = F.struct(*((word("l_suppkey") if k == "parties" else word("l_partkey") if k == "subjects" else none).alias(k) for k in dict.fromkeys(verdicts.ANCHORS.values())))
    m = m.select(
        F.col("l_orderkey").alias("event_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("rank").cast("string")).alias("id"), "rank", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), F.concat(F.lit("https://x.example/"), F.col("l_partkey").cast("string")).alias("url"),
        F.lit("desk").alias("source"), F.col("l_shipdate").cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("description"), F.when(F.col("rank") % 2 == 0, F.lit('say "so"')).alias("text"), facts.alias("facts"), word("l_suppkey").alias("matched_terms"), "l_suppkey", "l_partkey")
    e = m.where("rank = 1").select("event_id", F.when(F.col("event_id") % 4 == 0, "external").otherwise("direct").alias("route"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("company"), F.array(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("companies"), F.lit("high").alias("materiality"))
    picks = m.where("rank > 1").select(F.col("event_id").alias("group"), (F.col("rank") - 1).alias("pick"), "id")
    links = m.where("event_id % 4 = 0").select("event_id", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("company"), F.lit("mixed").alias("direction"), F.lit("cost").alias("mechanism"), F.lit("low").alias("materiality"), F.when(F.col("l_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string"))).alias("family"))
    return e, m, picks, links


_MEMBERS = """WITH x AS (SELECT *, l_orderkey || '/' || row_number() OVER w AS id, row_number() OVER w AS rank FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
y AS (SELECT *, '{"article_id":"' || id || '","title":"part ' || l_partkey || '",' AS head, '"source":"desk","published_at":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00') || '","description":null,"text":' || CASE WHEN rank % 2 = 0 THEN '"say \\"so\\""' ELSE 'null' END || '}' AS tail,
  '{"action_terms":[],"primary_action_terms":[],"secondary_action_terms":[],"counterparties":["s' || l_suppkey || '"],"milestone_terms":[],"explicit_date_tokens":[],"numeric_tokens":[],"amount_tokens":[],"percentage_tokens":[],"subject_terms":["p' || l_partkey || '"],"event_families":[]}' AS anchors FROM x)"""


@query(f"""{_MEMBERS}, z AS (SELECT *, head || '"url":"https://x.example/' || l_partkey || '",' || tail AS article, CASE l_partkey % 3 WHEN 0 THEN 'none' ELSE 'f' || l_partkey % 3 END AS fam FROM y),
f AS (SELECT l_orderkey, list_sort(list_distinct(list(fam) FILTER (fam <> 'none'))) AS fs, string_agg('{{"company":"s' || l_suppkey || '","impact_direction":"mixed","causal_mechanism":"cost","materiality":"low","event_family":"' || fam || '"}}', ',' ORDER BY 's' || l_suppkey, fam) AS ls FROM z GROUP BY 1)
SELECT l_orderkey AS event_id, '{{"route":"' || CASE WHEN l_orderkey % 4 = 0 THEN 'external' ELSE 'direct' END || '","event_id":' || l_orderkey || ',"company":"c' || l_orderkey || '","impacted_companies":["c' || l_orderkey || '"],"event_materiality":"high","canonical_event_anchors":' || max(anchors) FILTER (rank = 1)
  || ',"event_family_context":' || CASE WHEN l_orderkey % 4 = 0 THEN '{{"canonical_event_family":"' || coalesce(any_value(fs)[1], 'unknown') || '","source_event_families":' || CAST(to_json(coalesce(any_value(fs), [])) AS VARCHAR) || '}}' ELSE '{{}}' END
  || ',"representative_article":' || max(article) FILTER (rank = 1) || ',"corroborating_articles":[' || coalesce(string_agg(article, ',' ORDER BY rank) FILTER (rank IN (2, 3)), '') || ']' || CASE WHEN l_orderkey % 4 = 0 THEN ',"approved_impact_links":[' || any_value(ls) || ']' ELSE '' END || '}}' AS payload,
  list(id ORDER BY rank) FILTER (rank < 4) AS valid_ids FROM z JOIN f USING (l_orderkey) GROUP BY l_orderkey""")
def op_l17_evidence_payload(spark, d):
    """Payloads of direct and external events, every field."""
    return verdicts.evidence_payload(*_evidence(spark, d))


@query(f"""{_MEMBERS} SELECT l_orderkey AS event_id, '{{"company":"c' || l_orderkey || '","matched_identity_terms":' || CAST(to_json(list_sort(list_distinct(list('s' || l_suppkey)))) AS VARCHAR) || ',"event_id":' || l_orderkey || ',"coverage_count":' || count(*) || ',"anchors":' || max(anchors) FILTER (rank = 1)
  || ',"articles":[' || string_agg(head || tail, ',' ORDER BY rank) FILTER (rank < 5) || ']}}' AS payload FROM y GROUP BY l_orderkey""")
def op_l18_judge_payload(spark, d):
    e, m, _, _ = _evidence(spark, d)
    return verdicts.judge_payload(e, m)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN toxic = 1 THEN 'REJECT' ELSE 'ACCEPT' END WHEN quality = 1 THEN 'ACCEPT' ELSE 'REJECT' END AS final FROM labels")
def op_l20_recovered_final(spark, d):
    x = table(spark, d, "labels")
    audit = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("toxic") == 1, "REJECT").otherwise("ACCEPT")).otherwise("PENDING")
    return x.select("doc_id", verdicts.recovered_final(audit, F.col("quality") == 1).alias("final"))


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new fact' ELSE 'fact' END AS fact, CASE WHEN o_orderkey % 4 = 3 THEN 'new watch' ELSE 'watch' END AS watch, o_orderkey % 4 IN (1, 2) AS fallback FROM orders")
def op_l21_guarded_rewrite(spark, d):
    """By order: a core rewrite, a core rewrite that touches the watchpoint, an unsupported one, a watchpoint rewrite."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    v0 = o.select(F.col("o_orderkey").alias("event_id"), F.lit("fact").alias("fact"), F.lit("watch").alias("watch"))
    v1 = o.select(F.col("o_orderkey").alias("event_id"), F.when(k == 3, "watchpoint").otherwise("core").alias("kind"), (k != 2).alias("supported"), F.when(k < 3, "new fact").otherwise("fact").alias("fact"), F.when(k.isin(1, 3), "new watch").otherwise("watch").alias("watch"))
    return verdicts.guarded_rewrite(v0, v1, ["fact"], ["watch"])


@query("SELECT o_orderstatus AS tier, count(*) FILTER (quality = 1 AND toxic = 0) AS both, count(*) FILTER (quality = 1 AND toxic = 1) AS lost, count(*) FILTER (quality = 0 AND toxic = 0) AS gained, count(*) FILTER (quality = 0 AND toxic = 1) AS neither FROM labels JOIN orders ON doc_id = o_orderkey GROUP BY 1")
def op_i12_decision_report(spark, d):
    """Old decision by quality, new by toxicity."""
    x = table(spark, d, "labels").join(table(spark, d, "orders"), F.col("doc_id") == F.col("o_orderkey"))
    old = x.select(F.col("doc_id").alias("candidate_id"), (F.col("quality") == 1).alias("accept"))
    new = x.select(F.col("doc_id").alias("candidate_id"), (F.col("toxic") == 0).alias("accept"), F.col("o_orderstatus").alias("tier"))
    return metrics.decision_report(old, new)


_STAGE = "s[(len(s) - 1) // 2 + 1], 2) AS p50, round(s[least(len(s) - 1, CAST(floor(len(s) * 0.95) AS BIGINT)) + 1], 2) AS p95, round(s[len(s)], 2) AS max"


@query(f"""WITH x AS (SELECT *, CAST(user_id % 3 AS VARCHAR) AS stage, ['accept', 'reject', 'escalate', 'rate_limit', 'timeout', 'server_error', 'schema_failure', 'client_error'][event_id % 8 + 1] AS outcome FROM events),
g AS (SELECT stage, count(*) AS requests, count(*) FILTER (outcome = 'accept') AS accepts, count(*) FILTER (outcome = 'reject') AS rejects, count(*) FILTER (outcome = 'escalate') AS escalates, count(*) FILTER (outcome NOT IN ('accept', 'reject', 'escalate')) AS failures, sum(event_id % 5)::BIGINT AS retries,
  count(*) FILTER (outcome = 'rate_limit') AS rate_limits, count(*) FILTER (outcome = 'timeout') AS timeouts, count(*) FILTER (outcome = 'server_error') AS server_errors, count(*) FILTER (outcome = 'schema_failure') AS schema_failures, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS cached_tokens,
  sum(user_id)::BIGINT AS output_tokens, sum(event_id % 7)::BIGINT AS reasoning_tokens, list_sort(list(value)) AS s FROM x GROUP BY 1)
SELECT * EXCLUDE (s), round((accepts + rejects) / (SELECT count(*) FROM events), 5) AS resolution_rate, round(requests / (SELECT count(*) FROM events), 5) AS reached_rate, round({_STAGE} FROM g""")
def op_i6_stage_rates(spark, d):
    """Every counter of the stages."""
    e = table(spark, d, "events")
    outcome = F.element_at(F.array(*map(F.lit, ("accept", "reject", "escalate", "rate_limit", "timeout", "server_error", "schema_failure", "client_error"))), (F.col("event_id") % 8 + 1).cast("int"))
    k = F.col("event_id")
    rows = e.select((F.col("user_id") % 3).cast("string").alias("stage"), outcome.alias("outcome"), (k % 5).alias("retries"), F.col("value").alias("latency_ms"), (k % 1000).alias("input_tokens"), (k % 100).alias("cached_tokens"), F.col("user_id").alias("output_tokens"), (k % 7).alias("reasoning_tokens"))
    return metrics.stage_rates(rows, e.count())


def _replay(spark, d):
    x = table(spark, d, "labels")
    k = F.col("doc_id")
    tier1 = F.when(k % 5 == 0, "ACCEPT").when(k % 5 == 1, "REJECT").when(k % 5 == 2, "ESCALATE")
    asked = k % 5 >= 2
    failed = asked & (k % 7 == 0)
    accept = F.when(k % 5 == 0, True).when(k % 5 == 1, False).when(failed, True).otherwise(F.col("toxic") == 0)
    return x.select(k.alias("candidate_id"), (F.col("quality") == 1).alias("accept")), x.select(k.alias("candidate_id"), accept.alias("accept"), tier1.alias("tier1"), asked.alias("tier2"), failed.alias("failed"))


_REPLAY = "WITH x AS (SELECT doc_id AS id, quality = 1 AS old, doc_id % 5 AS k, doc_id % 5 >= 2 AS asked, doc_id % 5 >= 2 AND doc_id % 7 = 0 AS failed, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE doc_id % 7 = 0 OR toxic = 0 END AS new FROM labels)"


@query(f"{_REPLAY} SELECT count(*) AS candidates, count(*) FILTER (old) AS old_accept, count(*) FILTER (NOT old) AS old_reject, count(*) FILTER (k = 0) AS tier1_accept, count(*) FILTER (k = 1) AS tier1_reject, count(*) FILTER (k > 1) AS tier1_escalate, count(*) FILTER (asked) AS tier2_calls, count(*) FILTER (asked AND new AND NOT failed) AS tier2_accept, count(*) FILTER (asked AND NOT new) AS tier2_reject, count(*) FILTER (failed) AS failure_accept, count(*) FILTER (new) AS new_accept, count(*) FILTER (NOT new) AS new_reject, count(*) FILTER (old AND NOT new) AS lost, count(*) FILTER (new AND NOT old) AS gained, round(count(*) FILTER (k < 2) / count(*), 5) AS resolution_rate, round(count(*) FILTER (asked) / count(*), 5) AS escalation_rate FROM x")
def op_i12_replay_report(spark, d):
    """Old decisions by quality, new ones by two tiers of which the second fails at times."""
    return metrics.replay_report(*_replay(spark, d))


@query(f"{_REPLAY} SELECT id AS candidate_id, CASE WHEN old THEN 'lost' ELSE 'gained' END AS change, failed FROM x WHERE old <> new")
def op_i12_replay_changes(spark, d):
    return metrics.replay_changes(*_replay(spark, d)).select("candidate_id", "change", "failed")


@query("SELECT event_type AS stage, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS cached_tokens, sum(user_id)::BIGINT AS output_tokens, CASE WHEN event_type <> 'view' THEN round((sum(event_id % 1000 - event_id % 100) * 0.25 + sum(event_id % 100) * 0.025 + sum(user_id) * 2.0) / 1e6, 8) END AS cost FROM events GROUP BY 1")
def op_i7_stage_cost(spark, d):
    """One stage has no price."""
    e = table(spark, d, "events")
    usage = e.select(F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 100).alias("cached_tokens"), F.col("user_id").alias("output_tokens"))
    prices = e.select(F.col("event_type").alias("stage")).distinct().where("stage <> 'view'").select("stage", F.lit(0.25).alias("input"), F.lit(0.025).alias("cached"), F.lit(2.0).alias("output"))
    return metrics.stage_cost(usage, prices)


@query(f"{_CODES} SELECT x[4] AS reason, count(*) AS n FROM t GROUP BY 1")
def op_i8_reject_reasons(spark, d):
    return metrics.histogram(verdicts.two_tier(*_codes(spark, d)), "reason")


@query("SELECT c_custkey AS company_id, count(o_orderkey) AS collected, coalesce(count(*) FILTER (o_orderstatus <> 'P'), 0) AS fresh, coalesce(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS related FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def op_i9_funnel(spark, d):
    rows = table(spark, d, "orders").withColumn("company_id", F.col("o_custkey"))
    flags = {"collected": F.lit(True), "fresh": F.col("o_orderstatus") != "P", "related": F.col("o_orderpriority") == "1-URGENT"}
    return metrics.funnel(table(spark, d, "customer").select(F.col("c_custkey").alias("company_id")), rows, flags)


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AND count(*) FILTER (event_type = 'error') / count(*) >= 0.25 AS systemic FROM events")
def op_i11_systemic_failure(spark, d):
    return metrics.systemic_failure(table(spark, d, "events"), F.col("event_type") == "error")


@query("SELECT user_id % 50 AS company, event_type AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
def op_i17_identity_counters(spark, d):
    return metrics.histogram(table(spark, d, "events").select((F.col("user_id") % 50).alias("company"), F.col("event_type").alias("verdict")), "company", "verdict")


@query("SELECT user_id AS company_id, event_id AS id, CASE WHEN user_id % 4 = 0 THEN 'UNCERTAIN' ELSE event_type END AS verdict, CASE WHEN user_id % 4 = 0 THEN 'provider_no_audit' ELSE 'judged' END AS reason_code FROM events")
def op_i17_identity_audit(spark, d):
    """The audit row of every verdict, the defaults of incomplete batches included."""
    said = op_l1_batch_verdicts(spark, d)
    return metrics.identity_audit(said, F.when(F.col("verdict") != "UNCERTAIN", "judged"))


_TRACE = {name: i for i, (_, names) in enumerate(metrics.EDITORIAL.items()) for name in names}


@query("SELECT " + ", ".join(f"count(*) FILTER ((event_id + user_id) % {len(metrics.EDITORIAL) + 1} = {i}) AS {name}" for name, i in _TRACE.items()) + " FROM events")
def op_i18_editorial_counters(spark, d):
    """Events as the trace of an editorial run; one of thirteen kinds counts nothing."""
    e = table(spark, d, "events")
    kinds = F.array(*map(F.lit, (*metrics.EDITORIAL, "begin")))
    return metrics.editorial_counters(e.select(F.element_at(kinds, ((F.col("event_id") + F.col("user_id")) % (len(metrics.EDITORIAL) + 1) + 1).cast("int")).alias("event")))


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _parts(rows, order, n=3):
    """rows in n parts by value of `order`."""
    cuts = rows.approxQuantile(order, [k / n for k in range(1, n)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col(order) > low)
        yield part if high is None else part.where(F.col(order) <= high)


_RUNS = """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events), w(run, a, b) AS (VALUES (1, TIMESTAMP '2024-01-08 18:00:00', TIMESTAMP '2024-01-10 00:00:00'), (3, TIMESTAMP '2024-01-09 22:00:00', TIMESTAMP '2024-01-20 00:00:00'))"""


@query(f"{_RUNS} SELECT run, CASE WHEN ts IS NULL THEN 'missing' WHEN ts < a THEN 'too_old' WHEN ts > b THEN 'future' ELSE 'accepted' END AS freshness, count(*) AS n FROM e, w GROUP BY 1, 2")
def op_n1_incremental_freshness(spark, d):
    """Three runs, each over events that come as files: the second fails, so the third's window starts at the first's end. The counts are observed as each run writes its rows."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp")).alias("published_at"))
    source, out, ledger = (_scratch(spark, f"n1-{x}") for x in ("in", "out", "ledger"))
    e.write.parquet(source)
    told = []

    def fails(batch, batch_id):
        raise RuntimeError("planted")

    for run, (day, handle) in enumerate(((10, None), (15, fails), (20, None)), 1):
        stream = spark.readStream.schema(e.schema).parquet(source)
        now = datetime(2024, 1, day, tzinfo=UTC)
        try:
            counts = incremental.incremental_run(stream, ledger, f"{out}/run={run}", f"{out}-checkpoint-{run}", now, handle=handle)
            told += [(run, c, counts[c]) for c in incremental.CLASSES if counts[c]]
        except StreamingQueryException:
            continue
    return spark.createDataFrame(told, "run int, freshness string, n long")


@query("SELECT DISTINCT 'u' || user_id AS fingerprint FROM events WHERE user_id % 5 <> 0")
def op_n3_idempotent_delivery(spark, d):
    """Delivered twice from the same input; users divisible by five were sent before."""
    out, ledger = _scratch(spark, "n3"), _scratch(spark, "n3-ledger")
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"), "user_id")
    e.where("user_id % 5 = 0").select("fingerprint", F.lit("event").alias("kind")).distinct().write.parquet(f"{ledger}/batch=-1")
    handle = incremental.deliver(out, ledger)
    for batch in (0, 1, 0):
        handle(e.select("fingerprint"), batch)
    return spark.read.schema("fingerprint string").parquet(f"{out}/*").select("fingerprint")


_LIVE = f"{_FACTS}, v AS (SELECT * FROM e WHERE published_at >= (SELECT max(published_at) FROM e) - INTERVAL 720 HOURS), s AS (SELECT a.seq AS l, b.seq AS r FROM v a JOIN v b ON a.company = b.company AND (a.published_at, lower(a.url), a.seq) < (b.published_at, lower(b.url), b.seq) AND b.published_at - a.published_at <= INTERVAL 72 HOURS WHERE a.amounts = b.amounts AND a.primary_action = b.primary_action AND a.dates = b.dates)"


@query(f"{_LIVE} SELECT v.seq AS id, coalesce((SELECT min(l) FROM s WHERE s.r = v.seq), v.seq) AS \"group\" FROM v")
def op_n4_rolling_window(spark, d):
    """Headlines in three batches by time; the members of the last thirty days and their groups after the last one, as if that window were clustered anew."""
    h = ft.with_facts(views.headlines(spark, d)).withColumn("id", F.col("seq"))
    rows = stored(h.select(*rolling.ROW, F.unix_timestamp("published_at").cast("double").alias("at")), "n4-rows")
    source, state, out = (_scratch(spark, f"n4-{x}") for x in ("in", "state", "out"))
    handle = rolling.rolling_clusters(state, out, keep_hours=720)
    for part in _parts(rows, "at"):
        part.drop("at").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.drop("at").schema).parquet(source)
        incremental.run_batches(stream, handle, f"{out}-checkpoint").awaitTermination()
    return rolling.members(spark, state, rows.schema).select("id", "group")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'UNRELATED' ELSE 'RELATED' END AS verdict FROM events")
def op_o1_user_judge(spark, d):
    """O1: a rule as the user function."""

    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["event_id"], "verdict": ["UNRELATED" if x == "error" else "RELATED" for x in batch["event_type"]]})

    return verdicts.by_user_function(table(spark, d, "events").select("event_id", "event_type"), judge, "id long, verdict string")


@query("SELECT event_id AS left_id, event_id + 1 AS right_id, CASE WHEN user_id % 3 = 0 THEN 'SAME_EVENT' ELSE 'DIFFERENT_EVENT' END AS verdict FROM events")
def op_o3_user_resolver(spark, d):
    """O3: a rule in place of a pair resolver; its verdicts are what H19 takes."""

    def resolve(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"left_id": batch["event_id"], "right_id": batch["event_id"] + 1, "verdict": ["SAME_EVENT" if u % 3 == 0 else "DIFFERENT_EVENT" for u in batch["user_id"]]})

    return verdicts.by_user_function(table(spark, d, "events").select("event_id", "user_id"), resolve, "left_id long, right_id long, verdict string")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderpriority < '3' THEN 'DELIVER' ELSE 'IGNORE' END AS action, CASE WHEN o_orderpriority < '3' THEN o_clerk END AS fact FROM (SELECT o_orderkey, o_orderpriority, 'order ' || o_orderkey AS o_clerk FROM orders)")
def op_o4_user_assessment(spark, d):
    """A rule in place of a judge; its answers go through G5 and L6–L8."""
    o = table(spark, d, "orders")

    def assess(batch: pd.DataFrame) -> pd.DataFrame:
        send = batch["o_orderpriority"] < "3"
        fact = ("order " + batch["o_orderkey"].astype(str)).where(send, None)
        return pd.DataFrame({"event_id": batch["o_orderkey"], "action": ["DELIVER" if x else "IGNORE" for x in send], "materiality": ["high" if x else "none" for x in send], "fact": fact, "evidence_ids": [[k] if x else [] for k, x in zip(batch["o_orderkey"], send, strict=True)]})

    said = verdicts.by_user_function(o.select("o_orderkey", "o_orderpriority"), assess, "event_id long, action string, materiality string, fact string, evidence_ids array<long>")
    return verdicts.assessed(o.select(F.col("o_orderkey").alias("event_id"), F.array("o_orderkey").alias("member_ids")), said).select("event_id", "action", "fact")


@query("SELECT o_orderkey AS event_id, 'order ' || o_orderkey || ' of ' || o_custkey AS fact_summary FROM orders")
def op_o5_user_summary(spark, d):
    """A rule in place of a summary writer."""

    def write(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["o_orderkey"], "fact_summary": "order " + batch["o_orderkey"].astype(str) + " of " + batch["o_custkey"].astype(str)})

    return verdicts.by_user_function(table(spark, d, "orders").select("o_orderkey", "o_custkey"), write, "event_id long, fact_summary string")


@query("SELECT o_custkey AS company, o_orderstatus AS label, count(*) AS members FROM orders GROUP BY 1, 2")
def op_o2_user_grouping(spark, d):
    def group(part: pd.DataFrame) -> pd.DataFrame:
        g = part.groupby(["o_custkey", "o_orderstatus"]).size().reset_index(name="members")
        return g.rename(columns={"o_custkey": "company", "o_orderstatus": "label"})[["company", "label", "members"]]

    return verdicts.by_group_function(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], group, "company long, label string, members long", call_rows=5000)


@query("SELECT 'direct' AS stage, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'external', count(*) FROM orders WHERE o_orderkey % 2 = 1")
def op_a9_stage_snapshots(spark, d):
    path = _scratch(spark, "stages")
    o = table(spark, d, "orders").select("o_orderkey")
    io.write_stage(o.where("o_orderkey % 2 = 0"), path, "run", "direct")
    io.write_stage(o.where("o_orderkey % 2 = 1"), path, "run", "external")
    return metrics.histogram(spark.read.parquet(path), "stage")


def _saved(rows, places, path, size=500):
    """rows(_pos, record: JSON) as saved runs: JSON files of up to `size` records, in turn under each of the places (names from the outside in)."""
    from eventloom.operators.rank import chunked

    chunks = chunked(rows.withColumn("_all", F.floor(F.col("_pos") / 100_000)), ["_all"], [F.col("_pos")], size)
    listed = chunks.groupBy("_all", "chunk").agg(F.array_join(F.array_sort(F.collect_list("record")), ",").alias("rows"))
    made = F.element_at(F.array(*(F.concat(F.lit("".join(f'{{"{n}": ' for n in place) + "["), F.col("rows"), F.lit("]" + "}" * len(place))) for place in places)), (F.col("chunk") % len(places) + 1).cast("int"))
    listed.select(made.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@query("SELECT 'company-' || c_custkey AS company_id, c_name AS display_name, [lower(c_mktsegment)] AS search_terms FROM customer")
def op_a2_companies(spark, d):
    path = _scratch(spark, "companies")
    c = table(spark, d, "customer")
    c.select(F.concat(F.lit("company-"), F.col("c_custkey").cast("string")).alias("company_id"), F.col("c_name").alias("display_name"), F.array(F.lower("c_mktsegment")).alias("search_terms"), F.lit("x").alias("unknown")).write.json(path)
    return io.read_companies(spark, path).select("company_id", "display_name", "search_terms")


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'c/' || page_id ELSE url END AS canonical_url, CASE WHEN page_id % 2 = 0 THEN 'text ' || page_id END AS text FROM pages")
def op_a5_snapshot(spark, d):
    """Pages saved as runs' articles in both places; every seventh has no id, two of three no canonical url."""
    path = _scratch(spark, "snapshot")
    a = views.page_articles(spark, d)
    k = F.col("seq")
    record = F.to_json(F.struct(F.when(k % 7 != 0, k.cast("string")).alias("article_id"), "title", "url", F.when(k % 3 == 0, F.concat(F.lit("c/"), k.cast("string"))).alias("canonical_url"), F.when(k % 2 == 0, F.concat(F.lit("text "), k.cast("string"))).alias("text"), F.struct(F.lit("q").alias("query")).alias("origin_metadata")))
    _saved(a.select(k.alias("_pos"), record.alias("record")), (("stages", "enrichment", "articles"), ("debug", "journal_stages", "enrichment", "articles")), path)
    return io.read_snapshot(spark, path).select("url", "canonical_url", "text")


@query("SELECT 'order ' || o_orderkey AS title, CASE o_orderkey % 5 WHEN 3 THEN 'article lacks description, text' WHEN 4 THEN 'record lacks company or exposure' END AS reason, CASE o_orderkey % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END END AS baseline FROM orders")
def op_a6_judgments(spark, d):
    """Orders saved as judgments in both places: with the audit's decision (of five, two), with the judge's answer only, without two fields of the article, without an exposure."""
    path = _scratch(spark, "judgments")
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    parts = {"source": F.lit("s"), "source_type": F.lit("rss"), "title": F.concat(F.lit("order "), k.cast("string")), "url": F.concat(F.lit("https://x.example/"), k.cast("string")), "published_at": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "retrieved_at": null, "origin_metadata": F.struct(F.lit("q").alias("query"))}
    told = lambda p: F.to_json(F.struct(*(c.alias(n) for n, c in p.items())), {"ignoreNullFields": "false"})
    article = F.when(k % 5 == 3, told(parts)).otherwise(told(parts | {"description": null, "text": null}))
    exposure = F.to_json(F.struct(F.lit("e").alias("exposure_id"), F.lit("chips").alias("subject"), F.array(F.lit("supply")).alias("allowed_event_families")))
    judge = F.to_json(F.struct((k % 2 == 0).alias("qualifies"), F.struct(F.when(k % 5 == 0, "ACCEPT").when(k % 5 == 1, "REJECT").otherwise("PENDING").alias("final_decision")).alias("audit")))
    record = F.concat(F.lit('{"company": "c", "article": '), article, F.when(k % 5 == 4, "").otherwise(F.concat(F.lit(', "exposure": '), exposure)), F.lit(', "judge": '), judge, F.lit("}"))
    _saved(o.select(k.alias("_pos"), record.alias("record")), (("debug", "route_b", "judgments"), ("stages", "qualification", "judgments")), path)
    good, bad = io.read_judgments(spark, path)
    return good.select("title", F.lit(None).cast("string").alias("reason"), "baseline").union(bad.select("title", "reason", F.lit(None).cast("string")))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'jsonld' ELSE 'article_tag' END AS tier FROM pages")
def op_c2_jsonld(spark, d):
    """Every other page is given a JSON-LD article in a graph."""
    from eventloom.operators.pages import extracted

    p = table(spark, d, "pages")
    script = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "headline": "Headline of page '), F.col("page_id").cast("string"), F.lit('"}]}</script>'))
    return extracted(p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(script, F.col("html"))).otherwise(F.col("html")).alias("html"))).select("page_id", "tier")


@query("SELECT min(event_id) AS seq FROM events GROUP BY user_id")
def op_n2_stream_dedup(spark, d):
    """Events as a stream of articles whose url is their user's, in three batches; a url that an earlier batch retained stays out of the later ones. Retained keys are in the state store, here for longer than the stream lasts."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("url_key"), F.lit("").alias("title_key"), F.col("ts").cast("timestamp").alias("arrived"))
    source, out, work = (_scratch(spark, f"n2-{x}") for x in ("in", "out", "work"))
    for part in _parts(e, "seq"):
        part.write.mode("append").parquet(source)
        keyed.dedup_run(spark, spark.readStream.schema(e.schema).parquet(source), out, work, "400 days").awaitTermination()
    return spark.read.schema("seq long").parquet(f"{out}/*").select("seq")
