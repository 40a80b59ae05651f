"""Decision tables: model and human verdicts are input rows; these operators check, default, escalate and join them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import FILLER, has_filler, squeezed
from eventloom.sources.shared import told_parts

#: Reject codes and their reasons.
REJECT_REASONS = {
    "BROAD_INDUSTRY_ONLY": "broad_industry_only",
    "WRONG_CONTEXT": "wrong_context",
    "NON_MATERIAL": "non_material",
    "WRONG_JURISDICTION": "wrong_jurisdiction",
    "WEAK_CAUSAL_LINK": "weak_causal_link",
    "DUPLICATE_EVENT": "duplicate_event",
    "NO_MATERIAL_LINK": "weak_causal_link",
}
#: Materialities of direct events, and bounds of an assessment's parts.
MATERIALITIES = ("high", "medium", "none")
FACT_CHARS, INSIGHT_CHARS, MOST_EVIDENCE = 500, 350, 4
#: Fixed value: pattern of accept codes.
ACCEPT_CODE = r"^MATERIAL_LINK\|([a-z0-9_]+)\|(high|medium|low)\|(positive|negative|mixed|neutral)$"


def batch_verdicts(asked: DataFrame, answered: DataFrame, default: str = "UNCERTAIN") -> DataFrame:
    """L1: asked(batch_id, id), answered(batch_id, id, verdict): a batch's answer counts only if it has every id exactly once, else all are default."""
    got = asked.join(answered.groupBy("batch_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("verdict").alias("verdict")), ["batch_id", "id"], "full")
    asked_flag = asked.select("batch_id", "id", F.lit(True).alias("asked"))
    met = got.join(asked_flag, ["batch_id", "id"], "left")
    ok = met.groupBy("batch_id").agg(F.min(F.coalesce((F.col("n") == 1) & F.col("asked"), F.lit(False)).cast("int")).alias("whole"))
    return met.where("asked").join(ok, "batch_id").select("batch_id", "id", F.when(F.col("whole") == 1, F.col("verdict")).otherwise(default).alias("verdict"))


def partition_validity(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """L2: candidates(company, id), groups(company, group_no, members, representative, label) -> (company, valid): every id in exactly one group, representatives are members, labels are not blank.

    Asked and placed ids are counted in one aggregation, dealt out by id to a told number of parts: nothing is sorted or joined, and a large company is no task of its own."""
    shaped = (F.array_contains("members", F.col("representative")) & (F.trim("label") != "")).cast("int").alias("shaped")
    placed = groups.select("company", shaped, F.posexplode_outer("members").alias("pos", "id")).select("company", "id", F.lit(0).alias("asked"), F.col("pos").isNotNull().cast("int").alias("placed"), "shaped")
    asked = candidates.select("company", "id", F.lit(1).alias("asked"), F.lit(0).alias("placed"), F.lit(None).cast("int").alias("shaped"))
    dealt = asked.unionByName(placed).repartition(told_parts(candidates.sparkSession), "company", "id")
    met = dealt.groupBy("company", "id").agg(F.max("asked").alias("asked"), F.sum("placed").alias("placed"), F.min("shaped").alias("shaped"))
    once = ((F.col("asked") == 1) & (F.col("placed") == 1) & F.col("id").isNotNull()).cast("int")
    one = met.groupBy("company").agg(F.max("asked").alias("asked"), F.min(F.when((F.col("asked") == 1) | (F.col("placed") > 0), once)).alias("once"), F.min("shaped").alias("shaped"))
    return one.where("asked = 1").select("company", (F.col("company").isNotNull() & (F.coalesce("once", F.lit(0)) * F.coalesce("shaped", F.lit(0)) == 1)).alias("valid"))


def with_fallback(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """L3: groups of valid companies, singletons labelled by title[:160] for all others: no candidate is lost. Only companies are held in a join, a row each; candidates and groups stream past them unsorted."""
    valid = partition_validity(candidates, groups)
    of = lambda rows, which: rows.join(valid.where(which).select("company").hint("shuffle_hash"), "company", "left_semi")
    good = of(groups, "valid").select("company", "members", "representative", "label")
    single = of(candidates, "NOT valid").select("company", F.array("id").alias("members"), F.col("id").alias("representative"), F.substring("title", 1, 160).alias("label"))
    return good.unionByName(single)


def merged_partitions(first: DataFrame, later: list[DataFrame], max_passes: int = 3) -> DataFrame:
    """L4: first(company, id, group_id), later passes (company, group_id, merged_id): compose while a pass is complete for the company and reduces its groups; at most max_passes."""
    now = first
    for step in later[:max_passes]:
        met = now.join(step, ["company", "group_id"], "left")
        use = met.groupBy("company").agg((F.count_if(F.col("merged_id").isNull()) == 0).alias("whole"), F.count_distinct("group_id").alias("before"), F.count_distinct("merged_id").alias("after"))
        now = met.join(use, "company").select("company", "id", F.when(F.col("whole") & (F.col("after") < F.col("before")), F.col("merged_id")).otherwise(F.col("group_id")).alias("group_id"))
    return now


def compressed(members: DataFrame) -> DataFrame:
    """members(company, group_id, label, rank, title) -> label, representative title[:300], first two member titles[:180]."""
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "title")))), lambda s: s["title"])
    g = members.groupBy("company", "group_id", "label").agg(titles.alias("t"))
    return g.select("company", "group_id", "label", F.substring(F.get("t", F.lit(0)), 1, 300).alias("title"), F.transform(F.slice("t", 2, 2), lambda x: F.substring(x, 1, 180)).alias("more"))


def assessed(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """events(event_id, member_ids) left join verdicts(event_id, action, materiality, fact, insight, evidence_ids) -> action, reason, violation, materiality, fact, insight.

    An answer that its own rules forbid is none: the event ends as a failed assessment, as without an answer. One that names foreign evidence is ignored, and loses what it says."""
    if "insight" not in verdicts.columns:
        verdicts = verdicts.withColumn("insight", F.lit(None).cast("string"))
    met = events.join(verdicts.withColumn("_told", F.lit(True)), "event_id", "left")
    deliver = F.col("action") == "DELIVER"
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = F.col("materiality") == "none"
    evidence = F.coalesce(F.col("evidence_ids"), F.array().cast(events.schema["member_ids"].dataType))
    known = F.coalesce(F.col("action").isin("DELIVER", "IGNORE") & F.col("materiality").isin(*MATERIALITIES), F.lit(False))
    long = (F.length("fact") > FACT_CHARS) | (F.length("insight") > INSIGHT_CHARS) | (F.size(evidence) > MOST_EVIDENCE)
    violation = (
        F.when(F.col("_told").isNull(), F.lit(None)).when(~known, "unknown_value").when(F.coalesce(long, F.lit(False)), "too_long")
        .when(deliver & (none | empty("fact") | (F.size(evidence) == 0)), "incomplete_deliver").when(~deliver & (~none | ~empty("fact") | ~empty("insight")), "text_on_ignore")
    )  # L6
    foreign = F.size(F.array_except(evidence, F.col("member_ids"))) > 0
    reason = F.when(F.col("_told").isNull() | violation.isNotNull(), "model_assessment_failure").when(foreign, "invalid_evidence_id")  # L8, L7
    said = lambda c, other=None: F.when(reason.isNull(), F.col(c)).otherwise(F.lit(other)).alias(c)
    return met.select("event_id", said("action", "IGNORE"), reason.alias("reason"), violation.alias("violation"), said("materiality", "none"), said("fact"), said("insight"))


def grounded(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items(event_id, fact, insight, title, member_ids), verdicts(event_id, fact_ok, insight_ok, evidence_ids); an item without a verdict is dropped."""
    met = items.join(verdicts, "event_id")
    known = F.size(F.array_except("evidence_ids", "member_ids")) == 0
    return met.select("event_id", F.when(F.col("fact_ok") & known, F.col("fact")).otherwise(F.col("title")).alias("fact"), F.when(F.col("insight_ok") & known, F.col("insight")).alias("insight"))


def contract_violations(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates(candidate_id, company, exposure_id, families), decisions(candidate_id, company, exposure_id, qualifies, family, materiality, direction, reason) -> rows with `violation`. A reason null or `none` is none; a reject's direction is neutral."""
    d = decisions.select("candidate_id", *(F.col(c).alias(f"d_{c}") for c in ("company", "exposure_id", "qualifies", "family", "materiality", "direction", "reason")))
    met = candidates.join(d, "candidate_id")
    none = lambda c: F.coalesce(F.col(c), F.lit("none")) == "none"
    v = (
        F.when((F.col("company") != F.col("d_company")) | (F.col("exposure_id") != F.col("d_exposure_id")), "identity_changed")
        .when(F.col("d_qualifies") & ~F.array_contains("families", F.col("d_family")), "family_not_allowed")
        .when(F.col("d_qualifies") & none("d_materiality"), "missing_materiality").when(F.col("d_qualifies") & ~none("d_reason"), "reason_on_accept")
        .when(~F.col("d_qualifies") & (~none("d_family") | ~none("d_materiality") | ~F.col("d_direction").eqNullSafe(F.lit("neutral"))), "value_on_reject").when(~F.col("d_qualifies") & none("d_reason"), "missing_reason")
    )
    return met.withColumn("violation", v)


def accept_parts(code: Column, families: Column) -> Column:
    """struct(family, materiality, direction) of MATERIAL_LINK|family|materiality|direction; null unless the family is allowed."""
    part = lambda k: F.regexp_extract(code, ACCEPT_CODE, k)
    return F.when(code.rlike(ACCEPT_CODE) & F.array_contains(families, part(1)), F.struct(part(1).alias("family"), part(2).alias("materiality"), part(3).alias("direction")))


def reject_reason(code: Column) -> Column:
    """L12."""
    return F.element_at(F.create_map(*(F.lit(x) for p in REJECT_REASONS.items() for x in p)), code)


def two_tier(candidates: DataFrame, tier1: DataFrame, tier2: DataFrame, on_unresolved: str = "accept_low") -> DataFrame:
    """candidates(candidate_id, families), tiers(candidate_id, code): tier 1 accepts and rejects are final, else tier 2; what tier 2 doesn't settle is accepted as low
    with the first allowed family (`accept_low`), or rejected (`reject`)."""
    met = candidates.join(tier1.select("candidate_id", F.col("code").alias("c1")), "candidate_id", "left").join(tier2.select("candidate_id", F.col("code").alias("c2")), "candidate_id", "left")
    a1, a2 = accept_parts(F.col("c1"), F.col("families")), accept_parts(F.col("c2"), F.col("families"))
    r1, r2 = reject_reason(F.col("c1")), reject_reason(F.col("c2"))
    source = F.when(a1.isNotNull() | r1.isNotNull(), "tier1").when(a2.isNotNull() | r2.isNotNull(), "tier2").otherwise("conservative" if on_unresolved == "accept_low" else "unresolved")
    fallback = F.when(F.lit(on_unresolved == "accept_low"), F.struct(F.get("families", F.lit(0)).alias("family"), F.lit("low").alias("materiality"), F.lit("neutral").alias("direction")))
    accepted = F.when(a1.isNotNull(), a1).when(r1.isNull() & a2.isNotNull(), a2).when(r1.isNull() & r2.isNull(), fallback)
    reason = F.when(accepted.isNull(), F.coalesce(r1, r2, F.lit("unresolved")))
    return met.select("candidate_id", accepted.isNotNull().alias("qualifies"), accepted["family"].alias("family"), accepted["materiality"].alias("materiality"), accepted["direction"].alias("direction"), reason.alias("reason"), source.alias("decided_by"))


def summary_error(route: Column, why: Column, evidence: Column, known: Column, mode: Column, insight: Column) -> Column:
    """The first error of a summary; null if it is good. mode: implication or watchpoint; only a watchpoint's insight is searched for filler."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when((route == "external") & blank(why), "external_needs_why").when((route == "direct") & ~blank(why), "direct_has_why")
        .when(F.size(evidence) == 0, "evidence_missing").when(F.size(evidence) != F.size(F.array_distinct(evidence)), "evidence_repeated")
        .when(F.size(F.array_except(evidence, known)) > 0, "evidence_unknown").when((mode == "watchpoint") & has_filler(squeezed(F.coalesce(insight, F.lit(""))), FILLER), "filler")
    )


#: Safe watchpoints by dimension, and that of all other dimensions.
WATCHPOINTS = {
    "regulatory_clinical": "관련 임상·규제 진행과 공식 결과가 후속 발표에서 확인되는지 주시.",
    "financing_runway": "관련 자금조달·계약 집행의 공식 발표가 후속 보도에서 확인되는지 주시.",
    "customer_platform": "관련 기업의 실제 도입·계약·사업화 진전이 후속 보도나 공식 발표에서 확인되는지 주시.",
    "commercialization": "관련 제품·서비스의 실제 도입·사업화 진전이 후속 보도나 공식 발표에서 확인되는지 주시.",
    "competition": "관련 제품·서비스의 실제 도입과 시장 반응이 후속 보도에서 확인되는지 주시.",
}
OTHER_WATCHPOINT = "해당 사건의 실제 이행과 관련 공식 발표가 후속 보도에서 확인되는지 주시."
NO_TITLE = "대표 기사에 명시된 사건을 확인했습니다."
NO_MECHANISM = "승인된 회사별 영향 맥락을 후속 보도와 함께 확인할 필요가 있습니다."


def safe_summary(title: Column, mechanism: Column, dimension: Column, route: Column) -> Column:
    """Fact (title clause, 500), mechanism of external events (350) and a template watchpoint; each has a sentence for what is missing."""
    mark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in WATCHPOINTS.items() for x in p)), dimension), F.lit(OTHER_WATCHPOINT))
    said = lambda c, n, other: F.coalesce(F.nullif(F.substring(F.trim(c), 1, n), F.lit("")), F.lit(other))
    return F.struct(said(title, 500, NO_TITLE).alias("fact"), F.when(route == "external", said(mechanism, 350, NO_MECHANISM)).alias("mechanism"), mark.alias("watchpoint"))


#: Names of the facts in payloads, and the facts they come from.
ANCHORS = {
    "action_terms": "actions", "primary_action_terms": "primary", "secondary_action_terms": "secondary", "counterparties": "parties", "milestone_terms": "milestones", "explicit_date_tokens": "dates",
    "numeric_tokens": "numbers", "amount_tokens": "amounts", "percentage_tokens": "percentages", "subject_terms": "subjects", "event_families": "families",
}


def anchors(facts: Column) -> Column:
    return F.struct(*(F.array_sort(facts[k]).alias(name) for name, k in ANCHORS.items()))


def _article(url: bool) -> Column:
    """An article as payloads show it; null fields stay."""
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.struct(F.col("id").cast("string").alias("article_id"), "title", *(["url"] if url else []), "source", at.alias("published_at"), "description", "text")


_WHOLE = {"ignoreNullFields": "false"}


def evidence_payload(events: DataFrame, members: DataFrame, picks: DataFrame, links: DataFrame | None = None, limit: int = 2) -> DataFrame:
    """What a summary may rest on: events(event_id, route, company, companies, materiality), members(event_id, id, rank, title, url, source, published_at, description, text, facts), picks(group, pick, id) of `corroborating`,
    links(event_id, company, direction, mechanism, materiality, family) of external events -> (event_id, payload as JSON, valid_ids).

    The representative is the member of rank 1; the corroborating ones are the first `limit` picks (H17). An external event tells its families (the first of them is the canonical one, or unknown) and approved links. Only these members' texts are moved."""
    first = members.where("rank = 1").select("event_id", _article(True).alias("representative"), anchors(F.col("facts")).alias("anchors"))
    chosen = picks.where(F.col("pick") <= limit).select(F.col("group").alias("event_id"), "id", "pick")
    more = members.join(chosen, ["event_id", "id"]).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pick", _article(True).alias("a")))).alias("more"))
    met = events.join(first, "event_id").join(more, "event_id", "left").withColumn("corroborating", F.coalesce(F.transform("more", lambda s: s["a"]), F.array().cast("array<" + first.schema["representative"].dataType.simpleString() + ">")))
    external = F.col("route") == "external"
    approved = F.lit(None).cast("array<struct<company:string,impact_direction:string,causal_mechanism:string,materiality:string,event_family:string>>")
    if links is not None:
        link = F.struct("company", F.col("direction").alias("impact_direction"), F.col("mechanism").alias("causal_mechanism"), "materiality", F.col("family").alias("event_family"))
        told = links.groupBy("event_id").agg(F.array_sort(F.collect_list(link)).alias("links"), F.array_sort(F.collect_set(F.when(~F.col("family").isin("", "none"), F.col("family")))).alias("families"))
        met = met.join(told, "event_id", "left")
        approved = F.when(external, F.coalesce("links", F.array().cast(told.schema["links"].dataType)))
    families = F.coalesce(F.col("families"), F.array().cast("array<string>")) if links is not None else F.array().cast("array<string>")
    context = F.when(external, F.to_json(F.struct(F.coalesce(F.get(families, F.lit(0)), F.lit("unknown")).alias("canonical_event_family"), families.alias("source_event_families")))).otherwise("{}")
    parts = {"route": F.col("route"), "event_id": F.col("event_id"), "company": F.col("company"), "impacted_companies": F.col("companies"), "event_materiality": F.col("materiality"), "canonical_event_anchors": F.col("anchors")}
    body = lambda fields: F.regexp_extract(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), _WHOLE), r"(?s)^\{(.*)\}$", 1)
    rest = {"representative_article": F.col("representative"), "corroborating_articles": F.col("corroborating")}
    tail = F.coalesce(F.concat(F.lit(',"approved_impact_links":'), F.to_json(approved, _WHOLE)), F.lit(""))
    payload = F.concat(F.lit("{"), body(parts), F.lit(',"event_family_context":'), context, F.lit(","), body(rest), tail, F.lit("}"))
    ids = F.concat(F.array(F.col("representative.article_id")), F.transform("corroborating", lambda a: a["article_id"]))
    return met.select("event_id", payload.alias("payload"), ids.alias("valid_ids"))


def judge_payload(events: DataFrame, members: DataFrame, limit: int = 3) -> DataFrame:
    """What a judge of a direct event sees: events(event_id, company), members(event_id, id, rank, title, source, published_at, description, text, facts, matched_terms) -> (event_id, payload as JSON): the terms that any member matched,
    the number of members, the primary's facts, and the articles of the primary and the first `limit` others."""
    terms = members.select("event_id", F.explode("matched_terms").alias("term")).groupBy("event_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # distinct before they are gathered
    sizes = members.groupBy("event_id").agg(F.count(F.lit(1)).alias("coverage"))
    first = members.where("rank = 1").select("event_id", anchors(F.col("facts")).alias("anchors"))
    shown = members.where(F.col("rank") <= limit + 1).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", _article(False).alias("a")))), lambda s: s["a"]).alias("articles"))
    met = events.join(first, "event_id").join(sizes, "event_id").join(terms, "event_id", "left").join(shown, "event_id")
    none = F.array().cast("array<string>")
    payload = F.struct("company", F.coalesce("terms", none).alias("matched_identity_terms"), "event_id", F.col("coverage").alias("coverage_count"), "anchors", "articles")
    return met.select("event_id", F.to_json(payload, _WHOLE).alias("payload"))


def recovered_final(audit: Column, qualifies: Column) -> Column:
    """The audit's final decision if it is one, else what `qualifies` says."""
    return F.coalesce(F.when(audit.isin("ACCEPT", "REJECT"), audit), F.when(qualifies, "ACCEPT").when(~qualifies, "REJECT"))


def guarded_rewrite(v0: DataFrame, v1: DataFrame, core: list[str], insight: list[str], key: str = "event_id") -> DataFrame:
    """v1(key, kind core|watchpoint, supported, fields) may change only the fields of its kind; otherwise, or unsupported, the fields of version 0 stay and `fallback` is set."""
    new = v1.select(key, "kind", "supported", *(F.col(c).alias(f"n_{c}") for c in core + insight))
    met = v0.join(new, key, "left")
    same = lambda cols: F.least(F.lit(True), *(F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in cols))
    ok = F.coalesce(F.col("supported") & F.when(F.col("kind") == "core", same(insight)).otherwise(same(core)), F.lit(False))
    return met.select(key, *(F.when(ok, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in core + insight), (~ok).alias("fallback"))


def by_user_function(rows: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user function over Arrow batches of rows (an identity provider, pair resolver, judge or grounder) that returns verdict rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judge(batch)

    return rows.mapInPandas(run, schema)


def by_group_function(rows: DataFrame, chunk: list[str], group: Callable[[pd.DataFrame], pd.DataFrame], schema: str, call_rows: int | None = None) -> DataFrame:
    """O2: a user function over bounded chunks (J9) that returns a partition of each; L2 checks it. A call costs as much as hundreds of rows: with call_rows, the function gets whole chunks together, up to some so many rows,
    and tells them apart by the chunk's columns."""
    if call_rows is not None:
        call = F.pmod(F.xxhash64(*chunk), F.lit(rows.count() // call_rows + 1))
        return rows.groupBy(call.alias("call")).applyInPandas(group, schema)
    return rows.groupBy(*chunk).applyInPandas(group, schema)
