"""Queries for facts, pair decisions, clustering, representatives, ranking and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import facts as ft
from eventloom.functions import text as t
from eventloom.operators import cluster, metrics, rank, trail
from eventloom.plans.scalars import FOLD
from eventloom.sources import io, views
from eventloom.sources.shared import stored

Q = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


H = f"WITH {views.HEADLINES_SQL}"
FACTS = (
    H
    + """,
e AS (SELECT *, lower(title) AS lt, [['funding'], ['acquisition'], ['contract'], ['commercial_launch'], ['partnership']][level] AS primary_action, CASE level WHEN 3 THEN ['signed'] WHEN 4 THEN ['launch'] ELSE [] END AS milestones,
  ['USD:' || CAST(CAST(regexp_extract(title, '\\$([0-9]+) million', 1) AS BIGINT) * 1000000 AS VARCHAR)] AS amounts, [regexp_extract(title, '[0-9]{4}-[0-9]{2}-[0-9]{2}')] AS dates, [lower(replace(n_name, '_', '-'))] AS parties,
  list_sort(list_distinct(list_filter(regexp_extract_all(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')), '[a-z0-9]+'), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains(['a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'into', 'of', 'on', 'the', 'to', 'with', 'announces', 'announced', 'company', 'regulator', 'update', 'new', 'funding', 'acquisition', 'commercial_launch', 'launch', 'signed'] || CASE WHEN level = 3 THEN ['contract'] WHEN level = 5 THEN ['partnership'] ELSE [] END, w)))) AS subjects FROM h)"""
)


def _facts(spark, d):
    h = views.headlines(spark, d)
    return stored(ft.with_facts(h).withColumn("id", F.col("seq")), "facts")


@query(f"{FACTS} SELECT seq, primary_action AS primary, milestones FROM e")
def op_h4a_actions(spark, d):
    return ft.with_facts(views.headlines(spark, d)).select("seq", "facts.primary", "facts.milestones")


@query(f"{H} SELECT seq, CASE WHEN seq % 2 = 0 THEN [] ELSE ['clinical_trial'] END AS actions FROM h")
def op_h4b_aerospace(spark, d):
    """Trial words in half of the titles stand beside aerospace words."""
    h = views.headlines(spark, d)
    a = h.withColumn("title", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("로켓 phase 2 "), F.col("n_name"))).otherwise(F.concat(F.lit("phase 2 "), F.col("n_name"))))
    return ft.with_facts(a).select("seq", "facts.actions")


@query(f"{FACTS} SELECT seq, parties FROM e")
def op_h4d_counterparties(spark, d):
    return ft.with_facts(views.headlines(spark, d)).select("seq", "facts.parties")


@query(f"{FACTS} SELECT seq, amounts FROM e")
def op_h4e_amounts(spark, d):
    return views.headlines(spark, d).select("seq", ft.amounts(F.col("title")).alias("amounts"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(rtrim(printf('%.2f', l_discount), '0'), '.') END AS fraction FROM lineitem")
def op_h4f_percentages(spark, d):
    li = views.table(spark, d, "lineitem")
    text = F.concat(F.lit("down "), F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit(" percent this week"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(ft.percentages(text), 1).alias("fraction"))


@query("SELECT o_orderkey, [strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d')] AS dates FROM orders")
def op_h4g_dates(spark, d):
    """Order dates told in four ways; a bare day of the month is resolved by publication time."""
    o = views.table(spark, d, "orders")
    day = F.add_months("o_orderdate", 240)
    told = F.element_at(F.array(F.date_format(day, "yyyy.M.d"), F.date_format(day, "yyyy년 M월 d일"), F.date_format(day, "MMMM d, yyyy"), F.concat(F.dayofmonth(day).cast("string"), F.lit("일 발표"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", ft.dates(told, F.date_add(day, (F.col("o_orderkey") % 9).cast("int")).cast("timestamp")).alias("dates"))


@query(f"{FACTS} SELECT seq, subjects FROM e")
def op_h4h_subjects(spark, d):
    return ft.with_facts(views.headlines(spark, d)).select("seq", "facts.subjects")


@query(f"{H} SELECT seq, list_sort(list_distinct(regexp_extract_all(title || ' ' || coalesce(replace(description, '_', 'x'), ''), '\\b[0-9]+(?:\\.[0-9]+)?\\b'))) AS numbers FROM h")
def op_h4i_numbers(spark, d):
    return ft.with_facts(views.headlines(spark, d)).select("seq", "facts.numbers")


@query(f"{FACTS} SELECT seq, list_sort(list_distinct(primary_action || parties || milestones || dates || amounts || subjects)) AS words FROM e")
def op_h4j_signature(spark, d):
    return ft.with_facts(views.headlines(spark, d)).select("seq", F.array_sort(ft.signature(F.col("facts"))).alias("words"))


def _retold(spark, d):
    """Each headline beside the next of its order's customer (by seq)."""
    from pyspark.sql import Window

    f = _facts(spark, d)
    row = F.struct("seq", "id", "published_at", "title_key", "facts")
    return f.select("company", row.alias("l"), F.lead(row).over(Window.partitionBy("company").orderBy("seq")).alias("r")).where("r IS NOT NULL")


_NEXT = f"{FACTS}, p AS (SELECT *, lead(seq) OVER w AS r_seq, lead(amounts) OVER w AS r_amounts, lead(parties) OVER w AS r_parties, lead(primary_action) OVER w AS r_primary, lead(milestones) OVER w AS r_milestones, lead(dates) OVER w AS r_dates FROM e WINDOW w AS (PARTITION BY company ORDER BY seq))"


@query(f"{_NEXT} SELECT seq, r_seq, CASE WHEN amounts <> r_amounts THEN 'amount_conflict' WHEN parties <> r_parties THEN 'counterparty_conflict' WHEN primary_action <> r_primary THEN 'action_conflict' WHEN len(milestones) > 0 AND len(r_milestones) > 0 AND milestones <> r_milestones THEN 'milestone_conflict' WHEN dates <> r_dates THEN 'explicit_date_conflict' END AS conflict FROM p WHERE r_seq IS NOT NULL")
def op_h5a_conflicts(spark, d):
    return _retold(spark, d).select(F.col("l.seq").alias("seq"), F.col("r.seq").alias("r_seq"), ft.conflict(F.col("l.facts"), F.col("r.facts")).alias("conflict"))


@query(f"{_NEXT} SELECT seq, r_seq, amounts <> r_amounts OR parties <> r_parties OR primary_action <> r_primary OR dates <> r_dates OR (len(milestones) > 0 AND len(r_milestones) > 0 AND milestones <> r_milestones) AS mismatch FROM p WHERE r_seq IS NOT NULL")
def op_h5b_partial_mismatch(spark, d):
    return _retold(spark, d).select(F.col("l.seq").alias("seq"), F.col("r.seq").alias("r_seq"), ft.partial_mismatch(F.col("l.facts"), F.col("r.facts")).alias("mismatch"))


@query(f"{_NEXT} SELECT seq, r_seq, list_filter([CASE WHEN amounts = r_amounts THEN 'amount' END, CASE WHEN parties = r_parties THEN 'counterparty' END, CASE WHEN dates = r_dates THEN 'date' END], lambda x: x IS NOT NULL) AS shared FROM p WHERE r_seq IS NOT NULL")
def op_h5c_shared_identity(spark, d):
    return _retold(spark, d).select(F.col("l.seq").alias("seq"), F.col("r.seq").alias("r_seq"), ft.shared_identity(F.col("l.facts"), F.col("r.facts")).alias("shared"))


_SAME = f"{FACTS}, s AS (SELECT a.seq AS l, b.seq AS r, a.company FROM e a JOIN e b ON a.company = b.company AND (a.published_at, lower(a.url), a.seq) < (b.published_at, lower(b.url), b.seq) AND b.published_at - a.published_at <= INTERVAL 72 HOURS WHERE a.amounts = b.amounts AND a.parties = b.parties AND a.primary_action = b.primary_action AND a.milestones = b.milestones AND a.dates = b.dates)"


def _ordered(f):
    return f.withColumn("ord", F.struct(F.lower("company").alias("c"), F.col("published_at").isNull().alias("n"), F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), F.lower("url").alias("u"), F.col("id").alias("i")))


def _decided(spark, d):
    return cluster.decided(cluster.pairs(_ordered(_facts(spark, d)), ["company"]), F.col("company"))


@query(f"{_SAME} SELECT l, r FROM s")
def op_g3_same_pairs(spark, d):
    """SAME pairs of the blocked self-join."""
    met = cluster.likely_pairs(_ordered(_facts(spark, d)), ["company"])
    return cluster.decided(met, F.col("company")).where("decision = 'SAME_EVENT'").select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))


#: Headlines of which every fourth order's tell no fact, in order of their company; their groups (of two tellings at most) and what clustering compares.
_MIXED = (
    _SAME
    + """, x AS (SELECT e.* EXCLUDE (company), company, o_orderkey % 4 = 1 AS vague, row_number() OVER (PARTITION BY company ORDER BY published_at, lower(url), seq) AS pos FROM e),
f1 AS (SELECT s.r, min(x.pos) AS first FROM s JOIN x ON x.seq = s.l WHERE NOT vague GROUP BY s.r), z AS (SELECT x.*, coalesce(first, x.pos) AS first, g.seq AS grp FROM x LEFT JOIN f1 ON f1.r = x.seq JOIN x g ON g.company = x.company AND g.pos = coalesce(first, x.pos)),
t AS (SELECT a.company, a.seq AS l, b.seq AS r, b.grp, b.published_at - a.published_at <= INTERVAL 72 HOURS AS near, CASE WHEN b.published_at - a.published_at > INTERVAL 72 HOURS THEN 'DIFFERENT_EVENT' WHEN a.vague OR b.vague THEN 'AMBIGUOUS'
    WHEN a.amounts = b.amounts AND a.primary_action = b.primary_action AND a.dates = b.dates THEN 'SAME_EVENT' ELSE 'DIFFERENT_EVENT' END AS decision FROM z a JOIN z b ON a.company = b.company AND a.pos < b.pos AND a.first <= b.first)"""
)


def _mixed(spark, d):
    h = views.headlines(spark, d)
    h = h.withColumn("title", F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("story "), F.col("seq").cast("string"))).otherwise(F.col("title")))
    f = stored(_ordered(ft.with_facts(h).withColumn("id", F.col("seq"))), "mixed")
    same = cluster.same_pairs(f, ["company"], F.col("company"), cluster.WINDOW_HOURS, None)
    return f, cluster.greedy_groups(f, same), same


@query(f"{_MIXED} SELECT z.company, coalesce(any_value(n.compared), 0) AS compared, coalesce(any_value(beyond_window), 0) AS beyond_window, coalesce(any_value(same), 0) AS same, coalesce(any_value(different), 0) AS different, coalesce(any_value(ambiguous), 0) AS ambiguous FROM z LEFT JOIN (SELECT company, count(*) AS compared, count(*) FILTER (NOT near) AS beyond_window, count(*) FILTER (decision = 'SAME_EVENT') AS same, count(*) FILTER (decision = 'DIFFERENT_EVENT') AS different, count(*) FILTER (decision = 'AMBIGUOUS') AS ambiguous FROM t GROUP BY 1) n USING (company) GROUP BY z.company")
def op_i4_pair_counters(spark, d):
    """I4: decisions on all pairs that clustering compares, counted for each company without listing them."""
    f, groups, same = _mixed(spark, d)
    found = trail.pair_counters(f, groups, same=same)
    return found.select(F.col("scope").alias("company"), "compared", "beyond_window", "same", "different", "ambiguous")


_VAGUE = """WITH x AS (SELECT o_orderkey AS id, o_custkey AS company, o_orderdate AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
p AS (SELECT a.id AS l, b.id AS r, a.day + INTERVAL 72 HOURS < b.day AS late FROM x a JOIN x b ON a.company = b.company AND b.n = a.n + 1),
v AS (SELECT l, r, late, CASE WHEN late THEN FALSE ELSE l % 3 = 0 AND l % 2 = 0 END AS same FROM p)"""


def _vague(spark, d):
    """Each order beside its customer's next one: headlines that tell no fact, so that pairs within the window are AMBIGUOUS; and verdicts of which some are missing or failed."""
    from pyspark.sql import Window

    o = views.dealt_orders(spark, d)
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("company"), F.concat(F.lit("word"), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("description"), F.lit("").alias("text"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.lit("").alias("url"))
    f = stored(_ordered(ft.with_facts(a)), "vague")
    row = F.struct("ord", "id", "published_at", "title_key", "facts")
    met = f.select("company", row.alias("l"), F.lead(row).over(Window.partitionBy("company").orderBy("ord")).alias("r")).where("r IS NOT NULL")
    said = cluster.decided(met, F.col("company")).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "decision")
    verdict = F.when(F.col("left_id") % 2 == 0, "SAME_EVENT").otherwise("FAILED")
    return f, said, said.where("left_id % 3 = 0").select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), verdict.alias("verdict"))


@query(f"{_VAGUE}, c AS (SELECT r AS id, l AS grp FROM v WHERE same), g AS (SELECT x.*, coalesce(y.n, x.n) AS first FROM x LEFT JOIN c ON c.id = x.id AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.id = c.grp) LEFT JOIN x y ON y.id = c.grp) SELECT a.id AS left_id, b.id AS right_id, CASE WHEN coalesce(v.same, FALSE) THEN 'SAME_EVENT' ELSE 'DIFFERENT_EVENT' END AS final_decision, TRUE AS resolver_used FROM g a JOIN g b ON a.company = b.company AND a.n < b.n AND a.first <= b.first AND b.day <= a.day + INTERVAL 72 HOURS LEFT JOIN v ON v.l = a.id AND v.r = b.id")
def op_h19_resolved_pairs(spark, d):
    """Every pair within the window that clustering compares: no rule settles them, so they take the table's verdict; for a third of the neighbours there is one, half of these failed."""
    f, _, verdicts = _vague(spark, d)
    groups = stored(cluster.clustered(f.drop("ord"), verdicts=verdicts), "vague-groups")
    return trail.trail(f, groups, verdicts=verdicts, beyond=False).select("left_id", "right_id", "final_decision", "resolver_used")


@query(f"{_VAGUE}, c AS (SELECT r AS id, l AS \"group\" FROM v WHERE same) SELECT x.id, coalesce(c.\"group\", x.id) AS \"group\" FROM x LEFT JOIN c ON c.id = x.id AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.id = c.\"group\")")
def op_h19_resolved_clusters(spark, d):
    """Clusters that only the verdicts make. A row that would join a pair joins no one, since it isn't SAME with the pair's first row."""
    f, _, verdicts = _vague(spark, d)
    return cluster.clustered(f.drop("ord"), verdicts=verdicts)


@query(None)
def op_h7_title_ratio(spark, d):
    return _decided(spark, d).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"), F.round(cluster.title_ratio(F.col("l.title_key"), F.col("r.title_key")), 6).alias("ratio"))


_GROUP = f"{_SAME}, g AS (SELECT e.*, coalesce((SELECT min(l) FROM s WHERE s.r = e.seq AND s.l = (SELECT arg_min(x.seq, (x.published_at, lower(x.url), x.seq)) FROM e x JOIN s y ON y.l = x.seq WHERE y.r = e.seq)), e.seq) AS grp FROM e)"


def _groups(spark, d):
    """Headlines with scores and groups; scored before, so that a query shuffles only what it reads."""
    f = _facts(spark, d)
    return cluster.scored(f).join(cluster.clustered(f.select("id", "company", "published_at", "url", "title_key", "facts")), "id")


@query(f"{_SAME}, f1 AS (SELECT r, arg_min(l, (x.published_at, lower(x.url), x.seq)) AS first FROM s JOIN e x ON x.seq = s.l GROUP BY r) SELECT e.seq, coalesce(first, e.seq) AS \"group\" FROM e LEFT JOIN f1 ON f1.r = e.seq")
def op_h8_event_clusters(spark, d):
    return _groups(spark, d).select("seq", "group")


_SCORE = f"{FACTS}, sc AS (SELECT *, CASE o_orderkey % 3 WHEN 1 THEN 'source_of_record' WHEN 2 THEN 'aggregator_or_low_information' ELSE 'direct_publisher' END AS source_class, CASE o_orderkey % 3 WHEN 1 THEN 40 WHEN 2 THEN -30 ELSE 20 END + CASE WHEN description IS NOT NULL THEN CASE WHEN length(description) >= 60 THEN 10 ELSE 5 END ELSE -15 END + least(10, 3 * (len(amounts) + len(dates))) + least(10, 3 * len(list_distinct(parties || primary_action || CASE WHEN level = 3 THEN ['contract'] ELSE [] END || milestones))) AS total FROM e)"


@query(f"{_SCORE} SELECT seq, source_class FROM sc")
def op_h14_source_class(spark, d):
    h = views.headlines(spark, d)
    return h.select("seq", t.source_class(F.col("url"), F.col("source")).alias("source_class"))


@query(f"{_SCORE} SELECT seq, total::INTEGER AS total FROM sc")
def op_h15_representative_score(spark, d):
    return cluster.scored(ft.with_facts(views.headlines(spark, d))).select("seq", "score.total")


_REP = f"{_SCORE}, s AS (SELECT a.seq AS l, b.seq AS r FROM e a JOIN e b ON a.company = b.company AND (a.published_at, lower(a.url), a.seq) < (b.published_at, lower(b.url), b.seq) AND b.published_at - a.published_at <= INTERVAL 72 HOURS WHERE a.amounts = b.amounts AND a.primary_action = b.primary_action AND a.dates = b.dates), f1 AS (SELECT r, arg_min(l, (x.published_at, lower(x.url), x.seq)) AS first FROM s JOIN e x ON x.seq = s.l GROUP BY r), gg AS (SELECT sc.*, coalesce(first, sc.seq) AS grp FROM sc LEFT JOIN f1 ON f1.r = sc.seq), rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY total DESC, length(coalesce(description, '')) DESC, published_at, lower(url), seq) AS rank FROM gg)"


def _represented(spark, d):
    return cluster.represented(_groups(spark, d))


@query(f"{_REP} SELECT seq, grp AS \"group\", rank::INTEGER AS rank FROM rk")
def op_h16_representatives(spark, d):
    return _represented(spark, d).select("seq", "group", "rank")


@query(f"{_REP}, q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (url LIKE '%newsroom%')::INTEGER, total DESC, length(coalesce(description, '')) DESC, published_at, lower(url), seq) AS r2 FROM rk) SELECT grp AS \"group\", seq FROM q WHERE r2 = 1")
def op_h18_repost_override(spark, d):
    """Rows of one host count as reposts here; they stand for an event only if all its rows are such."""
    r = cluster.represented(_groups(spark, d), repost=F.col("url").contains("newsroom"))
    return r.where("rank = 1").select("group", "seq")


@query(f"{_REP} SELECT grp AS \"group\", 1 AS pick, seq AS id FROM rk WHERE rank = 2")
def op_h17_corroborating(spark, d):
    """Events have two tellings at most, so the pick is the other one."""
    return cluster.corroborating(_represented(spark, d))


@query(f"{_REP}, m AS (SELECT grp, company, arg_min(seq, rank) AS primary_id, count(*) AS coverage_count, string_agg(CAST(seq AS VARCHAR), '|' ORDER BY CAST(seq AS VARCHAR)) AS ids FROM rk GROUP BY 1, 2) SELECT primary_id, coverage_count, left(sha256('route_a|' || company || '|' || ids), 16) AS event_id FROM m")
def op_i15_event_coverage(spark, d):
    """Event ids, primaries and coverage."""
    return cluster.events(_represented(spark, d)).select("primary_id", "coverage_count", "event_id")


@query(f"{_REP} SELECT source_class, count(*) AS n FROM rk WHERE rank = 1 GROUP BY 1")
def op_i10_source_classes(spark, d):
    return metrics.histogram(_represented(spark, d).where("rank = 1"), "source_class")


_PRINTED = (
    FACTS
    + """, q AS (SELECT *, o_orderkey % 4 = 1 AS vague, CASE WHEN o_orderkey % 3 = 1 THEN 'external' ELSE 'direct' END AS route, CASE WHEN o_orderkey % 4 = 1 THEN 'story ' || seq ELSE title END AS told FROM e),
j AS (SELECT seq, CASE WHEN route = 'direct' THEN 'event' ELSE 'article' END AS kind, sha256(CASE WHEN route = 'direct' AND o_orderkey % 10 = 5 THEN 'label' || o_orderkey WHEN route = 'direct' AND NOT vague
  THEN '{"actions":' || CAST(to_json(primary_action) AS VARCHAR) || ',"amounts":' || CAST(to_json(amounts) AS VARCHAR) || ',"companies":' || CAST(to_json(CASE WHEN o_orderkey % 7 = 0 THEN list_sort([company, 'Other']) ELSE [company] END) AS VARCHAR) || ',"counterparties":' || CAST(to_json(parties) AS VARCHAR)
    || ',"dates":' || CAST(to_json(dates) AS VARCHAR) || ',"families":[],"milestones":' || CAST(to_json(milestones) AS VARCHAR) || ',"percentages":[],"route":"direct"}'
  ELSE route || '|' || company || '|' || url || '|' || told END) AS fingerprint FROM q)"""
)


@query(f"{_PRINTED} SELECT * FROM j")
def op_h20_fingerprint_kind(spark, d):
    """Direct and external items, some with the hash of their label, some with two companies, some without any fact."""
    return _fingerprints(spark, d).select("seq", "kind", "fingerprint")


def _fingerprints(spark, d):
    h = views.headlines(spark, d)
    f = ft.with_facts(h.withColumn("title", F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("story "), F.col("seq").cast("string"))).otherwise(F.col("title"))))
    companies = F.when(F.col("o_orderkey") % 7 == 0, F.array("company", F.lit("Other"))).otherwise(F.array("company"))
    label = F.when(F.col("o_orderkey") % 10 == 5, F.sha2(F.concat(F.lit("label"), F.col("o_orderkey").cast("string")), 256))
    return cluster.fingerprinted(f.withColumn("route", F.when(F.col("o_orderkey") % 3 == 1, "external").otherwise("direct")).withColumn("companies", companies).withColumn("label_hash", label))


@query(f"{_PRINTED} SELECT count(DISTINCT fingerprint) AS n FROM j")
def op_h20_distinct_events(spark, d):
    return _fingerprints(spark, d).agg(F.count_distinct("fingerprint").alias("n"))


def _links(spark, d):
    o = views.table(spark, d, "orders").join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select((F.col("o_orderkey") % 997).alias("group"), t.link_id(F.col("o_orderkey").cast("string")).alias("link_id"), F.col("c_name").alias("company"), F.when(level == 1, "high").when(level == 2, "medium").otherwise("low").alias("materiality"), F.when(level == 5, "none").otherwise(F.lower("o_orderstatus")).alias("family"))


@query("WITH l AS (SELECT o_orderkey % 997 AS g, left(sha256(CAST(o_orderkey AS VARCHAR)), 16) AS link_id, c_name, CAST(left(o_orderpriority, 1) AS INTEGER) AS lv, lower(o_orderstatus) AS fam FROM orders JOIN customer ON o_custkey = c_custkey) SELECT g AS \"group\", count(DISTINCT link_id) AS links, list_sort(list(DISTINCT c_name)) AS companies, CASE min(lv) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS materiality, coalesce(min(CASE WHEN lv < 5 THEN fam END), 'unknown') AS family FROM l GROUP BY 1")
def op_h11_external_events(spark, d):
    """H11–H13."""
    e = cluster.external_events(_links(spark, d))
    return e.select("group", F.size("links").cast("long").alias("links"), "companies", "materiality", "family")


@query(f"""WITH RECURSIVE a AS (SELECT doc_id AS id, 'u' || doc_id // 2 AS u, CASE WHEN doc_id % 5 <> 0 THEN nullif({FOLD.format("split_part(text, chr(10), 1)")}, '') || '|' || lower(source) || '|' || doc_id % 3 END AS f FROM documents),
k AS (SELECT id, u AS key FROM a UNION ALL SELECT id, f FROM a WHERE f IS NOT NULL), m AS (SELECT key, min(id) AS least FROM k GROUP BY 1), e AS (SELECT DISTINCT id AS x, least AS y FROM k JOIN m USING (key)), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT id, id AS reached FROM a UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.reached) SELECT id, min(reached) AS label FROM r GROUP BY 1""")
def op_h9_identity_groups(spark, d):
    """Documents on three days; every fifth has no time."""
    a = views.document_articles(spark, d)
    day = F.when(F.col("seq") % 5 != 0, F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("seq") % 3).cast("int")))
    return cluster.identity_groups(a.select(F.col("seq").alias("id"), F.lower("url").alias("url_key"), t.title_key(F.col("title")).alias("title_key"), "source", day.alias("published_at")))


_LINKS = f"{FACTS}, l AS (SELECT seq * 2 + j AS id, seq, e.* EXCLUDE (seq) FROM e, (VALUES (0), (1)) v(j) WHERE j = 0 OR o_orderkey % 5 = 0), s AS (SELECT a.seq AS l, b.seq AS r FROM e a JOIN e b ON a.seq < b.seq AND abs(epoch(b.published_at) - epoch(a.published_at)) <= 259200 WHERE a.amounts = b.amounts AND a.parties = b.parties AND a.primary_action = b.primary_action AND a.milestones = b.milestones AND a.dates = b.dates AND len(list_intersect(a.subjects, b.subjects)) > 0)"


def _external(spark, d):
    """Links of headlines to companies: every fifth order's headlines are linked to two."""
    f = _facts(spark, d).withColumn("families", F.array(F.lit("supply")))
    two = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    l = f.select("*", F.explode(two).alias("j")).withColumn("id", F.col("seq") * 2 + F.col("j"))
    l = l.withColumn("link_key", F.lpad(F.col("id").cast("string"), 20, "0")).withColumn("url_key", F.lower("url")).withColumn("company", F.when(F.col("j") == 1, F.lit("Other")).otherwise(F.col("company")))
    return l.withColumn("exposure_id", F.concat(F.lit("x"), F.col("j").cast("string"))).withColumn("family", F.lit("supply"))


@query(f"{_LINKS} SELECT l.id, l.seq * 2 AS identity, coalesce(least(l.seq, (SELECT min(s.l) FROM s WHERE s.r = l.seq)), l.seq) * 2 AS \"group\" FROM l")
def op_h10_external_clusters(spark, d):
    """Clusters across companies: links of one headline are one identity, its retelling is another of the same event. A group is shown by its smallest link."""
    from pyspark.sql import Window

    c = cluster.external_clusters(_external(spark, d))
    return c.select("id", "identity", F.min("id").over(Window.partitionBy("group")).alias("group"))


@query(f"{_LINKS} SELECT seq * 2 AS best, [seq * 2, seq * 2 + 1] AS link_ids, list_sort([company, 'Other']) AS companies, ['x0', 'x1'] AS exposures FROM e WHERE o_orderkey % 5 = 0")
def op_h10_identity_collapses(spark, d):
    links = _external(spark, d)
    return cluster.collapses(links, cluster.identities(links)).select("best", "link_ids", "companies", "exposures")


I = f"WITH {views.ITEMS_SQL}"


@query(f"{I} SELECT item_id, rank FROM r")
def op_j1_ranking(spark, d):
    return rank.ranked(views.ranked_items(spark, d)).select("item_id", "rank")


@query(f"{I}, c AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY rank) AS k FROM r) SELECT item_id FROM c WHERE k <= 3 ORDER BY rank LIMIT 200")
def op_j2_caps(spark, d):
    return rank.capped(views.ranked_items(spark, d), 3, 200).select("item_id")


@query(None)
def op_j2_shared_caps(spark, d):
    """With a total limit; against brute force in the tests."""
    return rank.capped_shared(rank.ranked(views.ranked_items(spark, d)), 3, 200).select("item_id")


@query(f"{I}, x AS (SELECT *, row_number() OVER (PARTITION BY kind, fingerprint ORDER BY rank) AS k, count(*) OVER (PARTITION BY kind, fingerprint) AS same_run FROM r) SELECT item_id, same_run FROM x WHERE k = 1")
def op_j3_same_run(spark, d):
    return rank.first_in_run(rank.ranked(views.ranked_items(spark, d))).select("item_id", "same_run")


@query(f"{I} SELECT company, min(rank) AS best_rank, list(item_id ORDER BY published_at DESC, rank) AS items FROM r GROUP BY 1")
def op_j4_digest(spark, d):
    return rank.digest(rank.ranked(views.ranked_items(spark, d)))


@query(f"{I}, x AS (SELECT item_id, materiality || '/' || route AS reason, row_number() OVER (PARTITION BY materiality || '/' || route ORDER BY item_id) AS nth FROM r) SELECT item_id, reason, nth::INTEGER AS nth FROM x ORDER BY nth, reason LIMIT 20")
def op_j5_round_robin(spark, d):
    items = views.ranked_items(spark, d).select("item_id", F.concat_ws("/", "materiality", "route").alias("reason"))
    return rank.round_robin(items, "reason", [F.col("item_id")], 20)


@query(f"{I} SELECT item_id, CASE WHEN row_number() OVER (PARTITION BY company ORDER BY rank) > 2 THEN 'over_cap' END AS cap_reason FROM r")
def op_j7_first_k(spark, d):
    items = views.ranked_items(spark, d).withColumn("priority", rank.priority())
    return rank.first_k(items, ["company"], rank.rank_order(), 2, "over_cap").select("item_id", "cap_reason")


@query(f"{I} SELECT item_id FROM i WHERE CAST(fingerprint AS BIGINT) % 5 <> 0")
def op_g4_unsent(spark, d):
    return rank.unsent(views.ranked_items(spark, d), views.sent_ledger(spark, d)).select("item_id")


@query(f"{I} SELECT route, materiality, count(*) AS n FROM i GROUP BY 1, 2")
def op_k1_union_routes(spark, d):
    items = views.ranked_items(spark, d)
    return metrics.histogram(items.where("route = 'direct'").unionByName(items.where("route = 'external'")), "route", "materiality")


@query("SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS shown FROM part GROUP BY 1")
def op_k2_distinct_keys(spark, d):
    p = views.table(spark, d, "part")
    return p.groupBy(t.query_key(F.col("p_name")).alias("key")).agg(F.min_by("p_name", "p_partkey").alias("shown"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def op_k3_set_difference(spark, d):
    c, o = views.table(spark, d, "customer"), views.table(spark, d, "orders")
    return c.select(F.col("c_custkey").alias("id")).exceptAll(o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct())


_PLAIN = "CASE o_orderkey % 3 WHEN 1 THEN 40 WHEN 2 THEN -30 ELSE 20 END + CASE WHEN description IS NOT NULL THEN CASE WHEN length(description) >= 60 THEN 10 ELSE 5 END ELSE -15 END"
_TOLD = "least(10, 3 * (len(amounts) + len(dates))) + least(10, 3 * len(list_distinct(parties || primary_action || CASE WHEN level = 3 THEN ['contract'] ELSE [] END || milestones)))"


@query(f"{_MIXED} SELECT grp AS event_id, count(*) AS members, max({_PLAIN} + CASE WHEN vague THEN 0 ELSE {_TOLD} END)::INTEGER AS best, coalesce(any_value(d.n), 0) AS decisions, coalesce(any_value(d.ambiguous), 0) AS ambiguous, coalesce(any_value(d.different), 0) AS different FROM z LEFT JOIN (SELECT grp, count(*) AS n, count(*) FILTER (decision = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (decision = 'DIFFERENT_EVENT') AS different FROM t WHERE near GROUP BY 1) d USING (grp) GROUP BY 1")
def op_a10_review_rows(spark, d):
    """Nested review rows of every event: its members, and the trail of the pairs within the window that were compared when they were clustered."""
    f, groups, _ = _mixed(spark, d)
    r = stored(cluster.represented(cluster.scored(f).join(groups, "id")).select(F.col("group").alias("event_id"), "company", "id", "rank", F.col("score.total").alias("score")), "mixed-ranks")
    ev, members = r.where("rank = 1").select("event_id", "company"), r.drop("company")
    rows = io.review_rows(ev, members, trail.trail(f, groups, beyond=False).withColumnRenamed("group", "event_id"))
    said = lambda kind: F.coalesce(F.size(F.filter("decisions", lambda x: x["decision"] == kind)), F.lit(0)).cast("long")
    return rows.select("event_id", F.size("members").cast("long").alias("members"), F.get("members", F.lit(0))["score"].alias("best"), F.coalesce(F.size("decisions"), F.lit(0)).cast("long").alias("decisions"), said("AMBIGUOUS").alias("ambiguous"), said("DIFFERENT_EVENT").alias("different"))
