"""Queries for freshness, dedup, registry, matching, exposure joins and aggregates over outcomes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventloom.functions import text as t
from eventloom.operators import dedup, ledger, match, metrics, rank, registry, windows
from eventloom.plans.scalars import CANON, FOLD
from eventloom.sources import views
from eventloom.sources.views import table

Q = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


def _fresh(spark, d, start, end):
    status = windows.freshness(F.col("ts").cast("timestamp"), start, end)
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "missing").otherwise(status).alias("freshness"))


@query("SELECT max(ts) - INTERVAL 2 HOURS AS window_start, TIMESTAMP '2024-01-20 00:00:00' AS window_end FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def op_d1_delivery_window(spark, d):
    """The last success is the last purchase before the run."""
    runs = table(spark, d, "events").where("event_type = 'purchase'").where(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    last = runs.agg(F.max("ts")).first()[0]
    start, end = windows.delivery_window(NOW, last.replace(tzinfo=timezone.utc) if last else None)
    return spark.range(1).select(_bound(start).alias("window_start"), _bound(end).alias("window_end"))


def _bound(x):
    return F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-17 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def op_d2_lookback(spark, d):
    start, end = windows.lookback_window(NOW, 3)
    return table(spark, d, "events").where(F.col("ts").between(_bound(start), _bound(end))).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN ts > TIMESTAMP '2024-01-20' THEN 'future' WHEN ts < TIMESTAMP '2024-01-10' THEN 'too_old' ELSE 'accepted' END AS freshness FROM events")
def op_d3_freshness(spark, d):
    return _fresh(spark, d, datetime(2024, 1, 10, tzinfo=timezone.utc), NOW)


@query("SELECT user_id, CAST(least(greatest(ceil((epoch(max(ts)) - epoch(min(ts))) / 86400), 1), 14) AS BIGINT) AS days FROM events GROUP BY user_id")
def op_d4_lookback_days(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(windows.lookback_days(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"), 14).alias("days"))


_PAGE_KEYS = f"""{CANON}, a AS (SELECT k.page_id AS seq, nullif(lower(canonical_url), '') AS u, nullif({FOLD.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '') AS ti FROM k JOIN pages USING (page_id))"""
_DOCUMENT_KEYS = f"""a AS (SELECT doc_id AS seq, 'https://news.example.com/story/' || doc_id // 2 AS u, nullif({FOLD.format("split_part(text, chr(10), 1)")}, '') AS ti FROM documents)"""
#: First wins, by recursion over the rows in order; us and ts are the keys taken so far.
_FIRST_WINS = """,
o AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM a),
g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, []::VARCHAR[] AS us, []::VARCHAR[] AS ts, FALSE AS stays
  UNION ALL SELECT o.n, o.seq, CASE WHEN d THEN us WHEN u IS NULL THEN us ELSE list_append(us, u) END, CASE WHEN d THEN ts WHEN ti IS NULL THEN ts ELSE list_append(ts, ti) END, NOT d
  FROM (SELECT g.us, g.ts, o2.*, coalesce(list_contains(g.us, o2.u), FALSE) OR coalesce(list_contains(g.ts, o2.ti), FALSE) AS d FROM g JOIN o o2 ON o2.n = g.n + 1) o),
kept AS (SELECT a.* FROM g JOIN a USING (seq) WHERE stays),
m AS (SELECT a.seq, CASE WHEN s.seq IS NOT NULL THEN a.seq WHEN ku.seq < a.seq THEN ku.seq ELSE kt.seq END AS primary_seq, CASE WHEN s.seq IS NOT NULL THEN NULL WHEN ku.seq < a.seq THEN 'canonical_url' ELSE 'normalized_title' END AS reason
  FROM a LEFT JOIN kept s ON s.seq = a.seq LEFT JOIN kept ku ON ku.u = a.u LEFT JOIN kept kt ON kt.ti = a.ti)"""
_RECUR = f"WITH RECURSIVE {_PAGE_KEYS}{_FIRST_WINS}"


def _page_map(spark, d):
    a = views.page_articles(spark, d)
    keyed = a.select("seq", F.lower(t.canonical_url(F.col("url"))).alias("url_key"), t.title_key(F.col("title")).alias("title_key"), "source")
    return keyed, dedup.dedup_map(keyed)


@query(f"{_RECUR} SELECT seq, primary_seq, reason FROM m")
def op_h1_article_dedup(spark, d):
    return _page_map(spark, d)[1]


@query(f"{_RECUR}, s AS (SELECT page_id AS seq, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS source FROM pages), x AS (SELECT primary_seq, source, min(seq) AS pos FROM m JOIN s USING (seq) GROUP BY 1, 2) SELECT primary_seq, list(source ORDER BY pos) AS queries FROM x GROUP BY 1")
def op_h2_merged_provenance(spark, d):
    keyed, mapped = _page_map(spark, d)
    return dedup.merged_provenance(keyed.withColumn("queries", F.array("source")), mapped, ["queries"])


@query(f"{_RECUR} SELECT primary_seq, count(*) AS duplicates, arg_min(reason, seq) AS reason FROM m WHERE reason IS NOT NULL GROUP BY 1")
def op_h3_duplicate_groups(spark, d):
    return dedup.duplicate_groups(_page_map(spark, d)[1])


@query(f"WITH RECURSIVE {_DOCUMENT_KEYS}{_FIRST_WINS} SELECT seq, primary_seq, reason FROM m")
def op_h1_document_dedup(spark, d):
    a = views.document_articles(spark, d)
    return dedup.dedup_map(a.select("seq", F.lower("url").alias("url_key"), t.title_key(F.col("title")).alias("title_key")))


def _companies(spark, d):
    c = table(spark, d, "customer")
    terms = F.array(F.col("c_name"), F.upper("c_mktsegment"), F.concat(F.lit("segment "), F.lower("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("company-"), F.col("c_custkey").cast("string")).alias("company_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, F.array().cast("array<string>")).otherwise(terms).alias("search_terms"))


_E1 = """c AS (SELECT c_custkey AS pos, 'company-' || c_custkey AS company_id, [c_name, upper(c_mktsegment), 'segment ' || lower(c_mktsegment)] AS terms FROM customer WHERE c_custkey % 10 <> 0),
x AS (SELECT pos, company_id, generate_subscripts(terms, 1) AS i, unnest(terms) AS term FROM c)"""


@query(f"WITH {_E1} SELECT lower(term) AS query_key, arg_min(term, pos * 10 + i) AS display_query, list(company_id ORDER BY pos) AS company_ids FROM x GROUP BY 1")
def op_e1_query_owners(spark, d):
    return registry.query_owners(_companies(spark, d))


@query("SELECT 'company-' || c_custkey AS company_id FROM customer WHERE c_custkey % 10 = 0")
def op_e2_uncovered(spark, d):
    c = _companies(spark, d)
    return registry.uncovered(c, registry.query_owners(c))


def _exposures(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("company"), F.col("p_type").alias("query_term")).agg(F.min("p_partkey").alias("k")).select(
        "company", F.concat_ws("/", "company", "query_term").alias("exposure_id"), "query_term", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("k") % 2000).cast("int")).alias("valid_from"), F.array(F.lit("supply"), F.lit("price")).alias("families"))


_X = "x AS (SELECT p_brand AS company, p_brand || '/' || p_type AS exposure_id, lower(p_type) AS query_key, DATE '1995-01-01' + CAST(min(p_partkey) % 2000 AS INTEGER) AS valid_from FROM part GROUP BY p_brand, p_type)"


@query(f"WITH {_X} SELECT query_key, count(*) AS links, CAST(min(valid_from) AS VARCHAR) AS earliest FROM x GROUP BY 1")
def op_e3_exposure_links(spark, d):
    links = registry.exposure_links(_exposures(spark, d))
    return links.select("query_key", F.size("links").cast("long").alias("links"), F.array_min(F.transform("links", lambda x: x["valid_from"])).cast("string").alias("earliest"))


@query(f"WITH {_E1}, y AS (SELECT lower(term) AS query_key, pos * 10 + i AS place, term AS query, 0 AS route_order FROM x UNION ALL SELECT lower(p_type), min(p_partkey), min(p_type), 1 FROM part GROUP BY p_type) SELECT query_key, arg_min(query, route_order * 1000000000 + place) AS query, min(route_order) AS route_order FROM y GROUP BY 1")
def op_e4_union_queries(spark, d):
    direct = _companies(spark, d).select("pos", F.posexplode("search_terms").alias("i", "query")).select((F.col("pos") * 10 + F.col("i")).alias("pos"), "query")
    external = table(spark, d, "part").groupBy(F.col("p_type").alias("query")).agg(F.min("p_partkey").alias("pos")).select("pos", "query")
    return registry.union_queries([direct, external])


def _asked(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = table(spark, d, "part")
    j = o.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_orderkey").agg(F.min("p_type").alias("p_type"), F.min("o_orderdate").alias("o_orderdate"))
    key = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 10 == 1, "unknown").otherwise(F.lower("p_type"))
    return j.select(F.col("o_orderkey").alias("seq"), key.alias("query_key"), F.when(F.col("o_orderkey") % 10 != 2, F.col("o_orderdate").cast("timestamp")).alias("published_at"))


_ASKED = "q AS (SELECT o_orderkey AS seq, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE lower(min(p_type)) END AS query_key, CASE WHEN o_orderkey % 10 <> 2 THEN min(o_orderdate) END AS published_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey)"
_G2 = f"WITH {_X}, {_ASKED}, j AS (SELECT q.seq, exposure_id, CASE WHEN coalesce(q.query_key, '') = '' THEN 'missing_query' WHEN exposure_id IS NULL THEN 'unregistered_query' WHEN published_at IS NULL THEN 'missing_timestamp' WHEN CAST(published_at AS DATE) < valid_from THEN 'before_valid_from' END AS rejection FROM q LEFT JOIN x USING (query_key))"


def _exposed(spark, d):
    return windows.exposed(_asked(spark, d), _exposures(spark, d).withColumn("query_key", t.query_key(F.col("query_term"))))


@query(f"{_G2} SELECT seq, exposure_id, rejection FROM j")
def op_g2_exposure_join(spark, d):
    return _exposed(spark, d).select("seq", "exposure_id", "rejection")


@query(f"{_G2} SELECT seq, exposure_id FROM j WHERE rejection IS NULL")
def op_d5_valid_candidates(spark, d):
    return _exposed(spark, d).where("rejection IS NULL").select("seq", "exposure_id")


@query(f"{_G2} SELECT rejection, count(*) AS n FROM j WHERE rejection IS NOT NULL GROUP BY 1")
def op_d6_rejections(spark, d):
    return metrics.histogram(_exposed(spark, d).where("rejection IS NOT NULL"), "rejection")


def _terms(spark, d):
    n = table(spark, d, "nation")
    none = F.array().cast("array<string>")
    return n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("company_id"), F.replace("n_name", F.lit("_"), F.lit("-")).alias("term"),
        F.when(F.col("n_nationkey") % 5 == 1, F.array(F.lit("acquires"))).otherwise(none).alias("negative"), F.when(F.col("n_nationkey") % 5 == 2, F.array(F.lit("launches"), F.lit("raises"))).otherwise(none).alias("required"),
        (F.col("n_nationkey") % 5 == 1).alias("forbidden"), F.when(F.col("n_nationkey") % 5 == 1, F.array(F.lit("report"), F.lit("contract"))).otherwise(none).alias("forbidden_required"),
        F.when(F.col("n_nationkey") % 5 == 3, F.array(F.lit("partnership"))).otherwise(none).alias("english_negative"), F.when(F.col("n_nationkey") % 5 == 4, F.array(F.lit("says source"))).otherwise(none).alias("english_required"),
    )


_F1 = f"""WITH {views.HEADLINES_SQL}, tm AS (SELECT n_nationkey AS k, lower(replace(n_name, '_', '-')) AS term, 'n' || n_nationkey AS company_id FROM nation), hh AS (SELECT *, lower(title) AS lt FROM h),
f1 AS (SELECT seq, company_id, term FROM hh JOIN tm ON replace(hh.n_name, '_', '-') = upper(term) AND regexp_matches(lt || '|', term || '[^0-9a-z]')
  WHERE (k % 5 <> 1 OR (NOT contains(lt, 'acquires') AND (regexp_matches(lt, '(^|[^a-z0-9])report([^a-z0-9]|$)') OR contains(lt, 'contract')))) AND (k % 5 <> 2 OR contains(lt, 'launches') OR contains(lt, 'raises')) AND (k % 5 <> 3 OR NOT contains(lt, 'partnership')) AND (k % 5 <> 4 OR contains(lt, 'says source')))"""


@query(f"{_F1} SELECT seq, company_id, [upper(term)] AS matched_terms FROM f1")
def op_f1_entity_match(spark, d):
    """F1 with F4–F10: nation terms with negative, required, forbidden and English contexts against all headlines."""
    return match.matches(views.headlines(spark, d), _terms(spark, d), "seq", F.col("title"))


def _owned(spark, d):
    a = views.headlines(spark, d)
    a = a.select("seq", F.array(F.concat(F.lit("n"), (F.col("seq") % 40).cast("string"))).alias("explicit_ids"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("query"), F.array().cast("array<string>").alias("origin_queries"))
    owners = _terms(spark, d).groupBy(t.query_key(F.col("term")).alias("query_key")).agg(F.array_sort(F.collect_set("company_id")).alias("company_ids"))
    return match.owners(a, owners, _terms(spark, d).select("company_id"))


@query(f"WITH {views.HEADLINES_SQL}, nk AS (SELECT n_name, n_nationkey FROM nation), z AS (SELECT seq, CASE WHEN seq % 40 < (SELECT count(*) FROM nation) THEN seq % 40 END AS e, n_nationkey AS o FROM h JOIN nk USING (n_name)) SELECT seq, CASE WHEN e IS NULL OR e = o THEN ['n' || o] ELSE ['n' || e, 'n' || o] END AS company_ids FROM z")
def op_f3_owners(spark, d):
    return _owned(spark, d)


@query(f"{_F1} SELECT seq, company_id, [upper(term)] AS matched_terms FROM f1")
def op_f2_scoped_match(spark, d):
    return match.scoped_matches(views.headlines(spark, d), _terms(spark, d), _owned(spark, d), "seq", F.col("title"))


@query("SELECT lower(p_type) AS identity, arg_min(p_brand, p_partkey) AS rule FROM part GROUP BY 1")
def op_f11_alias_rules(spark, d):
    return match.first_rules(table(spark, d, "part").select(t.identity_key(F.col("p_type")).alias("identity"), F.col("p_brand").alias("rule"), F.col("p_partkey").alias("pos")))


@query("SELECT 'company-' || c_custkey AS company_id, c.c_name AS name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def op_g8_known_companies(spark, d):
    return _companies(spark, d).join(table(spark, d, "orders").select(F.col("o_custkey").alias("pos")), "pos", "left_semi").select("company_id", "name")


@query(f"WITH {_E1}, k AS (SELECT lower(term) AS query_key, list(company_id ORDER BY pos) AS ids FROM x GROUP BY 1) SELECT o_orderkey, ids AS company_ids FROM orders JOIN customer ON o_custkey = c_custkey JOIN k ON query_key = lower(c_name)")
def op_g1_query_join(spark, d):
    owners = registry.query_owners(_companies(spark, d))
    asked = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", t.query_key(F.col("c_name")).alias("query_key"))
    return asked.join(owners, "query_key").select("o_orderkey", "company_ids")


@query("SELECT c_custkey AS pos, lower(c_name) AS identity, c_name AS display_name, len(list_distinct([c_name, CASE WHEN c_custkey % 4 = 0 THEN 'Old ' || c_name END, CASE WHEN c_custkey % 3 = 0 THEN 'Alias ' || c_name END])) AS terms, c_custkey % 3 = 0 AS matched FROM customer")
def op_a4_build_companies(spark, d):
    made = _built(spark, d)
    return made.select("pos", "identity", "display_name", F.size("terms").cast("long").alias("terms"), "matched")


def _built(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_custkey").alias("pos"), F.concat(F.col("c_name"), F.lit(" Inc."), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" (구, Old "), F.col("c_name"), F.lit(")"))).otherwise("")).alias("name"))
    aliases = c.where("c_custkey % 3 = 0").select(t.identity_key(F.col("c_name")).alias("identity"), F.array(F.concat(F.lit("Alias "), F.col("c_name"))).alias("terms"), F.col("c_custkey").alias("pos"))
    return registry.build_companies(names, aliases)


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 4 = 0) AS former_names, count(*) FILTER (c_custkey % 3 = 0) AS matched, count(*) FILTER (c_custkey % 3 <> 0) AS unmatched, 0::BIGINT AS short_names, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 3 <> 0) AS single_term, 0::BIGINT AS duplicate_names FROM customer")
def op_i13_build_profile(spark, d):
    return registry.build_profile(_built(spark, d))


@query("SELECT 'M3_term_shared' AS \"check\", lower(c_mktsegment) AS key FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 1 UNION ALL SELECT 'M4_term_repeated', 'company-' || c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 13 <> 0 UNION ALL SELECT 'M4_term_repeated', 'C_' || c_custkey FROM customer WHERE c_custkey % 91 = 0 UNION ALL SELECT 'M1_id_pattern', 'C_' || c_custkey FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT 'M1_count', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'M3_term_shared', 'twin' || c_custkey // 2 FROM customer GROUP BY c_custkey // 2 HAVING count(*) > 1")
def op_m1_dimension_faults(spark, d):
    """M1–M4; planted are a wrong count, shared segments (half of them with a legal form), twins that differ in their legal form only, ids of a wrong pattern, and a repeated term for every seventh company."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    legal = F.when(k % 2 == 0, " Inc.").otherwise("")
    terms = F.concat(F.array(F.col("c_name"), F.concat("c_mktsegment", legal), F.concat(F.lit("Twin"), F.expr("c_custkey div 2").cast("string"), legal)), F.when(k % 7 == 0, F.array(F.upper("c_name"))).otherwise(F.array().cast("array<string>")))
    made = c.select(F.concat(F.when(k % 13 == 0, "C_").otherwise("company-"), k.cast("string")).alias("company_id"), F.col("c_name").alias("name"), terms.alias("terms"))
    return registry.dimension_faults(made, declared=0)


@query("SELECT 'M5_family_unknown' AS \"check\", p_type AS key FROM part WHERE p_type LIKE 'E%' GROUP BY p_type UNION ALL SELECT 'M5_exposure_repeated', p_brand || p_type FROM part GROUP BY p_brand, p_type HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'M5_family_without_rule', p_type FROM part WHERE p_type LIKE 'S%' UNION ALL SELECT DISTINCT 'M6_closure', p_brand FROM part WHERE right(p_brand, 1) = '1'")
def op_m5_exposure_faults(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.col("p_brand").alias("company"), F.concat("p_brand", "p_type").alias("exposure_id"), F.array("p_type").alias("families"))
    known = p.select(F.col("p_type").alias("family")).distinct().where("family NOT LIKE 'E%'")
    return registry.exposure_faults(e, known, e.where("company LIKE '%1'").select("company", F.lit(True).alias("closed")).distinct(), known.where("family NOT LIKE 'S%'"))


def _outcomes(spark, d):
    o = views.feed_outcomes(spark, d)
    return o.withColumn("o", t.feed_outcome(F.col("http_status"), F.col("error"))).select("*", "o.status", "o.transient", "o.signal").drop("o")


@query(f"WITH {views.OUTCOMES_SQL}, g AS (SELECT * REPLACE (CASE event_id % 17 WHEN 1 THEN 'collection_deadline' WHEN 2 THEN 'parse_error' WHEN 3 THEN 'skipped_systemic_failure' WHEN 4 THEN 'connection_error' ELSE status END AS status) FROM f) SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (status = 'success') / count(*) AS success_ratio, count(*) FILTER (status = 'rate_limited') AS rate_limited, count(*) FILTER (status = 'service_unavailable') AS unavailable, count(*) FILTER (status = 'http_error' AND http_status BETWEEN 500 AND 599) AS other_5xx, count(*) FILTER (status IN ('timeout', 'collection_deadline')) AS timeouts, count(*) FILTER (status = 'connection_error') AS connection_errors, count(*) FILTER (status = 'parse_error') AS parse_errors, count(*) FILTER (status = 'skipped_systemic_failure') AS skipped, sum(retry_attempts)::BIGINT AS retries, sum(event_id % 3)::BIGINT AS retry_after_used FROM g")
def op_i1_feed_metrics(spark, d):
    """Some outcomes are replaced by those that no code tells."""
    k = F.col("event_id") % 17
    status = F.when(k == 1, "collection_deadline").when(k == 2, "parse_error").when(k == 3, "skipped_systemic_failure").when(k == 4, "connection_error").otherwise(F.col("status"))
    return metrics.feed_metrics(_outcomes(spark, d).withColumn("status", status).withColumn("retry_after_used", F.col("event_id") % 3))


_GATE = f"WITH {views.OUTCOMES_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'success') / count(*) AS ratio, count(*) FILTER (status = 'success') / count(*) >= {{0}} AS sufficient, count(*) FILTER (status = 'success') / count(*) >= 0.98 AS zero_news_healthy FROM f"


@query(_GATE.format("0.9"))
def op_i2_coverage_gate(spark, d):
    return metrics.coverage_gate(_outcomes(spark, d))


@query(f"WITH {views.OUTCOMES_SQL} SELECT count(*) FILTER (status = 'success') / count(*) >= 0.98 AS zero_news_healthy FROM f")
def op_i3_zero_news_gate(spark, d):
    return metrics.coverage_gate(_outcomes(spark, d)).select("zero_news_healthy")


@query("SELECT event_type, round(s[(len(s) - 1) // 2 + 1], 2) AS p50, round(s[least(len(s) - 1, CAST(floor(len(s) * 0.95) AS BIGINT)) + 1], 2) AS p95, round(s[len(s)], 2) AS max FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1)")
def op_i5_latencies(spark, d):
    return metrics.latencies(table(spark, d, "events"), "value", ["event_type"])


@query("SELECT event_type AS stage, count(*) FILTER (user_id % 3 = 0) AS started, count(*) FILTER (user_id % 3 = 1) AS completed, count(*) FILTER (user_id % 3 = 2) AS failed, arg_max(event_id, (ts, event_id)) AS last_item FROM events GROUP BY 1")
def op_i16_progress(spark, d):
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("started", "completed", "failed"))), (F.col("user_id") % 3 + 1).cast("int"))
    return metrics.progress(e.select(F.col("event_type").alias("stage"), status.alias("status"), F.col("event_id").alias("item"), "ts"))


@query(f"WITH {views.OUTCOMES_SQL} SELECT event_id, round(avg(transient::INTEGER) OVER w, 6) AS transient_share, count(*) OVER w = 6 AND avg(transient::INTEGER) OVER w >= 0.8 AS alarm FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def op_j8_rolling_failure(spark, d):
    return metrics.rolling_failure(_outcomes(spark, d).withColumn("transient", F.col("signal")), ["user_id"], ["ts", "event_id"]).select("event_id", "transient_share", "alarm")


@query("SELECT c.column_name AS \"column\", nonblank, distinct_values AS \"distinct\", round(distinct_values / nonblank, 6) AS unique_ratio, nonblank BETWEEN 20 AND 1000 AS eligible FROM (SELECT 'c_name' AS column_name, count(c_name) AS nonblank, count(DISTINCT c_name) AS distinct_values FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer) c")
def op_i14_column_profile(spark, d):
    return metrics.column_profile(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query("WITH f AS (SELECT DISTINCT 'event' AS kind, CAST(user_id AS VARCHAR) AS fingerprint FROM events), l AS (SELECT kind, fingerprint, CAST(fingerprint AS BIGINT) AS seq FROM f WHERE CAST(fingerprint AS BIGINT) % 2 = 0), n AS (SELECT *, row_number() OVER (ORDER BY CAST(fingerprint AS BIGINT), fingerprint) + (SELECT max(seq) FROM l) AS seq FROM f WHERE CAST(fingerprint AS BIGINT) % 2 = 1), a AS (SELECT * FROM l UNION ALL SELECT * FROM n) SELECT kind, fingerprint, seq FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS r FROM a) WHERE r <= 50")
def op_a7_sent_ledger(spark, d):
    """Even users are in the ledger, all users arrive; the newest 50 stay."""
    e = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("user_id").cast("string").alias("fingerprint"), F.col("user_id").alias("seq")).distinct()
    return ledger.appended_sent(e.where("seq % 2 = 0"), e.select("kind", "fingerprint", F.col("seq").alias("pos")), keep=50)


@query("SELECT event_type AS mode, arg_max(event_id, ts) AS checkpoint FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def op_a8_checkpoints(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("ts").alias("at"), F.col("event_type").alias("mode"), F.when(F.col("user_id") % 3 == 0, "failed").otherwise("success").alias("status"), F.col("event_id").alias("checkpoint"))
    return ledger.last_checkpoint(runs).select("mode", "checkpoint")


@query("SELECT kind, fingerprint, seq FROM (SELECT event_type AS kind, CAST(event_id AS VARCHAR) AS fingerprint, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50")
def op_j6_newest(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("fingerprint"), F.col("event_id").alias("seq"))
    return rank.newest(e, ["kind"], F.desc("seq"), 50)


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 25 AS chunk FROM events")
def op_j9_chunks(spark, d):
    return rank.chunked(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 25).select("user_id", "event_id", "chunk")
