"""Queries for text, URL, hash and date scalars, sources and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as t
from eventloom.operators import pages as pg
from eventloom.operators.registry import hashed_sample
from eventloom.sources import io, views
from eventloom.sources.views import table

Q = {}
FOLD = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


CANON = """
c AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
c2 AS (SELECT page_id, url, string_split(bare, '?')[1] AS head, CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END AS q FROM c),
c3 AS (SELECT page_id, url, head, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT (lower(p) LIKE 'utm\\_%' ESCAPE '\\') AND NOT lower(string_split(p, '=')[1]) IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS ps FROM c2),
k AS (SELECT page_id, url, CASE WHEN len(ps) = 0 THEN head ELSE head || '?' || array_to_string(list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') END AS canonical_url FROM c3)"""


@query(f"WITH {CANON} SELECT page_id, canonical_url FROM k")
def op_b1_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", t.canonical_url(F.col("url")).alias("canonical_url"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s]+', ' ', 'g')) AS query_key FROM documents")
def op_b2_query_key(spark, d):
    return table(spark, d, "documents").select("doc_id", t.query_key(F.col("text")).alias("query_key"))


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS plain FROM pages")
def op_b3_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", t.plain_text(F.col("html")).alias("plain"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'Supplier desk' ELSE 'Unknown' END AS publisher FROM supplier")
def op_b4_publisher_name(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", t.publisher_name(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")), F.when(F.col("s_suppkey") % 3 == 1, F.lit(" Supplier desk ")).otherwise("")).alias("publisher"))


@query("SELECT event_id, date_trunc('second', ts) AS published_at FROM events")
def op_b5_published_at(spark, d):
    """RFC 2822 text made of each event's time, in three zones (one of them named, with a year of two digits) and without one, read back to UTC."""
    e = table(spark, d, "events").withColumn("utc", F.col("ts").cast("timestamp"))
    local = lambda hours: F.date_format(F.col("utc") + F.expr(f"INTERVAL {hours} HOURS"), "EEE, dd MMM yyyy HH:mm:ss")
    short = F.date_format(F.col("utc") - F.expr("INTERVAL 5 HOURS"), "EEE, dd MMM yy HH:mm:ss")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(short, F.lit(" EST"))).when(F.col("event_id") % 3 == 0, F.concat(local(0), F.lit(" GMT"))).when(F.col("event_id") % 3 == 1, F.concat(local(9), F.lit(" +0900"))).otherwise(local(0))
    return e.select("event_id", t.published_at(text).cast("timestamp_ntz").alias("published_at"))


@query(f"SELECT doc_id, {FOLD.format('split_part(text, chr(10), 1)')} AS title_key FROM documents")
def op_b6_title_key(spark, d):
    return views.document_articles(spark, d).select(F.col("seq").alias("doc_id"), t.title_key(F.col("title")).alias("title_key"))


_NAMES = "concat_ws(' ', c_name, ['Inc.', 'Ltd', '주식회사', '', 'Limited'][c_custkey % 5 + 1])"


def _company_names(spark, d):
    form = F.element_at(F.array(*map(F.lit, ("Inc.", "Ltd", "주식회사", "", "Limited"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_name", form).alias("name"))


@query(f"SELECT c_custkey, trim(regexp_replace(replace(lower({_NAMES}), ' ', ''), '(inc\\.?|ltd\\.?|limited|주식회사)$', ''), ' ,.') AS identity FROM customer")
def op_b7_identity_key(spark, d):
    return _company_names(spark, d).select("c_custkey", t.identity_key(F.col("name")).alias("identity"))


@query("SELECT s_suppkey, s_name AS current_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Old ' || s_name END AS former_name, FALSE AS malformed FROM supplier")
def op_b8_source_name(spark, d):
    s = table(spark, d, "supplier").withColumn("raw", F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" (구, Old "), "s_name", F.lit(")"))).otherwise(F.col("s_name")))
    return s.select("s_suppkey", t.source_name(F.col("raw")).alias("n")).select("s_suppkey", F.col("n.current").alias("current_name"), F.col("n.former").alias("former_name"), "n.malformed")


@query("SELECT c_custkey, c_name AS display_name FROM customer")
def op_b9_display_name(spark, d):
    forms = _company_names(spark, d).withColumn("name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("(주) "), "name", F.lit(", Ltd."))).otherwise(F.rtrim("name")))
    return forms.select("c_custkey", t.display_name(F.col("name")).alias("display_name"))


@query("SELECT c_custkey, 'company-' || left(sha256(lower(c_name)), 16) AS company_id FROM customer")
def op_b10_company_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.company_id(F.col("c_name")).alias("company_id"))


_AID = f"left(sha256(lower(trim(canonical_url)) || '|' || {FOLD.format('title')} || '|' || strftime(TIMESTAMP '2026-01-01' + to_minutes(CAST(page_id * 37 AS INTEGER)), '%Y-%m-%d %H:%M:%S') || '+00:00'), 16)"
_PAGES = f"WITH {CANON}, a AS (SELECT k.page_id, k.canonical_url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM k JOIN pages USING (page_id))"


@query(f"{_PAGES} SELECT page_id, {_AID} AS article_id FROM a")
def op_b11_article_id(spark, d):
    a = views.page_articles(spark, d)
    return a.select(F.col("seq").alias("page_id"), t.article_id(t.canonical_url(F.col("url")), F.col("title"), F.col("published_at")).alias("article_id"))


@query("SELECT o_custkey, left(sha256('route_a|Customer ' || o_custkey || '|' || string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY CAST(o_orderkey AS VARCHAR))), 16) AS event_id FROM orders GROUP BY o_custkey")
def op_b12_event_id(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("ids"))
    return o.select("o_custkey", t.event_id(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.col("ids")).alias("event_id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, left(sha256(l_orderkey || '|' || l_partkey || '|' || l_linenumber), 16) AS link_id, sha256(l_orderkey || '|' || l_suppkey) AS candidate_id FROM lineitem")
def op_b13_link_ids(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", t.link_id(s("l_orderkey"), s("l_partkey"), s("l_linenumber")).alias("link_id"), t.candidate_id(s("l_orderkey"), s("l_suppkey")).alias("candidate_id"))


@query("SELECT p_brand, p_type, 2 AS terms FROM part GROUP BY p_brand, p_type")
def op_b14_distinct_terms(spark, d):
    """Terms of every brand and type in three spellings each; two folded forms remain."""
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    terms = F.array("p_brand", F.upper("p_brand"), F.lit(" "), "p_type", F.lower("p_type"), "p_brand")
    p = p.withColumn("terms", terms).withColumn("keys", F.transform("terms", lambda x: F.lower(F.trim(x))))
    return p.select("p_brand", "p_type", F.size(t.distinct_terms(F.col("terms"), F.col("keys"))).alias("terms"))


@query("SELECT p_partkey, length(p_name) <= 5 OR len(list_filter(string_split(p_name, ' '), lambda w: length(w) <= 3)) > 0 AS short_name FROM part")
def op_b15_short_ascii(spark, d):
    return table(spark, d, "part").select("p_partkey", t.short_ascii(F.col("p_name")).alias("short_name"))


@query("SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def op_b16_safe_url(spark, d):
    p = table(spark, d, "pages")
    odd = F.element_at(F.array(F.col("url"), F.regexp_replace("url", "://[^/?#]+", "://10.0.0.7"), F.regexp_replace("url", "://", "://me:pw@"), F.regexp_replace("url", "^https?", "ftp")), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", t.safe_url(odd).alias("safe"))


@query("SELECT page_id, page_id % 2 = 0 AS aggregator, CASE WHEN page_id % 2 = 0 THEN 'https://news.google.com/articles/' || page_id || '?oc=5&hl=en-US&gl=US&ceid=US%3Aen' ELSE url END AS target FROM pages")
def op_b17_wrapper_target(spark, d):
    p = table(spark, d, "pages")
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), F.col("page_id").cast("string"), F.lit("?oc=5#x"))).otherwise(F.col("url"))
    return p.select("page_id", t.is_aggregator(u).alias("aggregator"), t.wrapper_target(u).alias("target"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(p_type)) THEN p_name ELSE p_type END AS clause FROM part")
def op_b18_title_clause(spark, d):
    p = table(spark, d, "part")
    title = F.concat(F.col("p_name"), F.lit("; "), F.col("p_type"), F.lit(" | other"))
    return p.select("p_partkey", t.title_clause(title, F.array("p_type", F.lit("zzz"))).alias("clause"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age
FROM (SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT, 0) AS s FROM events)""")
def op_b19_relative_age(spark, d):
    return table(spark, d, "events").select("event_id", t.relative_age(F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("age"))


@query("SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE text END, 1400) AS lead FROM documents")
def op_b20_lead_text(spark, d):
    a = views.document_articles(spark, d)
    return a.select(F.col("seq").alias("doc_id"), t.lead_text(F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("text")), F.col("description")).alias("lead"))


@query("SELECT doc_id, replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), 'x', '-') AS folded FROM documents")
def op_b21_match_fold(spark, d):
    a = views.document_articles(spark, d)
    return a.select(F.col("seq").alias("doc_id"), t.match_fold(F.translate("title", "xX", "–—")).alias("folded"))


@query(f"WITH {views.OUTCOMES_SQL} SELECT event_id, status, transient FROM f")
def op_b22_outcome_class(spark, d):
    o = views.feed_outcomes(spark, d)
    return o.select("event_id", t.feed_outcome(F.col("http_status"), F.col("error")).alias("o")).select("event_id", "o.status", "o.transient")


_LOG = ("429 too many", "read timeout", "5xx", "server error", "malformed reply", "connection reset", "refused")


def _log(spark, d):
    """Every status code beside every error text, by event."""
    e = table(spark, d, "events")
    code = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 407, 429, 451, 500, 502, 503, 504))), (F.col("event_id") % 11 + 1).cast("int"))
    error = F.element_at(F.array(*map(F.lit, _LOG)), (F.expr("event_id div 11") % len(_LOG) + 1).cast("int"))
    return e.select("event_id", F.when(F.col("event_id") % 4 != 1, code).alias("code"), F.when(F.col("event_id") % 4 != 0, error).alias("error"))


_LOG_SQL = f"WITH x AS (SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN [200, 401, 403, 404, 407, 429, 451, 500, 502, 503, 504][event_id % 11 + 1] END AS code, CASE WHEN event_id % 4 <> 0 THEN {list(_LOG)}[event_id // 11 % {len(_LOG)} + 1] ELSE '' END AS e FROM events)"


@query(f"""{_LOG_SQL} SELECT event_id, CASE WHEN code = 429 THEN 'rate_limited' WHEN code = 503 THEN 'service_unavailable' WHEN code >= 400 THEN 'http_error' WHEN e LIKE '%connect%' THEN 'connection_error' WHEN e LIKE '%timeout%' THEN 'timeout' WHEN e <> '' THEN 'http_error' ELSE 'success' END AS status,
coalesce(code IN (429, 502, 503, 504), FALSE) OR (coalesce(code, 0) < 400 AND (e LIKE '%timeout%' OR e LIKE '%connect%')) AS transient FROM x""")
def op_b22_feed_outcomes(spark, d):
    return _log(spark, d).select("event_id", t.feed_outcome(F.col("code"), F.col("error")).alias("o")).select("event_id", "o.status", "o.transient")


@query(f"{_LOG_SQL} SELECT event_id, CASE WHEN e LIKE '%timeout%' THEN 'timeout' WHEN code IN (401, 403, 407, 429, 451) THEN 'blocked' WHEN code >= 400 OR e <> '' THEN 'http_error' ELSE 'success' END AS status FROM x")
def op_b22_page_outcomes(spark, d):
    return _log(spark, d).select("event_id", t.page_outcome(F.col("code"), F.col("error")).alias("status"))


@query(f"""{_LOG_SQL} SELECT event_id, 'tier1_' || CASE WHEN e LIKE '%timeout%' THEN 'timeout' WHEN coalesce(code, 0) = 429 OR e LIKE '%429%' THEN '429_exhausted' WHEN coalesce(code, 0) >= 500 OR e LIKE '%5xx%' OR e LIKE '%server error%' THEN '5xx_exhausted' WHEN e LIKE '%malformed%' THEN 'schema_failure' ELSE 'client_error' END AS reason,
coalesce(code, 0) = 429 OR coalesce(code, 0) >= 500 OR regexp_matches(e, '429|5xx|server error|connection|timeout') AS retryable FROM x""")
def op_b22_stage_reasons(spark, d):
    return _log(spark, d).select("event_id", t.stage_reason(F.col("code"), F.col("error"), "tier1").alias("o")).select("event_id", "o.reason", "o.retryable")


@query("SELECT o_orderkey, left(sha256(o_orderpriority || '|' || lower(o_comment_)), 16) AS event_id FROM (SELECT *, 'Signed ORDER ' || o_orderkey % 50 AS o_comment_ FROM orders)")
def op_b12_labelled_event(spark, d):
    """Ids of events that have a label."""
    label = F.concat(F.lit("Signed ORDER "), (F.col("o_orderkey") % 50).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.substring(t.labelled_event_hash(F.col("o_orderpriority"), label), 1, 16).alias("event_id"))


@query(f"WITH {CANON} SELECT page_id, canonical_url, url FROM k WHERE page_id % 5 <> 0")
def op_a1_feed_articles(spark, d):
    """Pages as feed items; every fifth one lacks its title."""
    p = table(spark, d, "pages")
    items = p.select("page_id", F.when(F.col("page_id") % 5 != 0, F.lit("x")).alias("title"), F.col("url").alias("link"), F.lit("a &amp; b").alias("description"), F.lit("").alias("summary"), F.lit("Thu, 01 Jan 2026 00:00:00 GMT").alias("pubDate"), F.lit("s").alias("source"))
    return io.feed_articles(items, "q", keep=("page_id",)).select("page_id", "canonical_url", "url")


@query("SELECT p_brand AS company, p_brand || '/' || p_type AS exposure_id, lower(p_type) AS query_term FROM part GROUP BY p_brand, p_type")
def op_a3_exposure_terms(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    e = F.struct(F.concat_ws("/", "p_brand", "p_type").alias("exposure_id"), F.struct(F.col("p_type").alias("canonical"), F.array(F.lower("p_type")).alias("query_terms")).alias("subject"), F.lit(None).cast("date").alias("valid_from"), F.array(F.lit("supply")).alias("allowed_event_families"))
    nested = p.groupBy(F.col("p_brand").alias("company")).agg(F.collect_list(e).alias("exposures"))
    return io.exposure_terms(nested).select("company", "exposure_id", "query_term")


def _evidence(spark, d):
    return pg.extracted(table(spark, d, "pages"))


@query(None)
def op_c1_page_evidence(spark, d):
    return _evidence(spark, d)


_LINK_KINDS = (  # what stands before every page's own html, by page_id modulo 8; {0} is its number
    """<a href="https://news.google.com/x">1</a><link href='https://pub.example.com/story/{0}' rel="alternate canonical">""",
    """<link rel=canonical href=//cdn.example.org/{0}><a href="https://z.example.com/">z</a>""",
    """<link rel="canonical"><meta content="../up/{0}?a=1&amp;b=2" property='og:url'>""",
    """<!-- <a href="https://hidden.example.com/"> --><script>'<a href="https://script.example.com/">'</script><a class=x href='?q={0}'>q</a>""",
    """<a href="mailto:x@example.com">m</a><a href="http://127.0.0.1/{0}">l</a><a href="HTTPS://Other.example.com/{0}">o</a>""",
    """<meta name="og:url" content="https://wrong.example.com/"><a href="https://user:pw@pub.example.com/">u</a><a href="/root/{0}">r</a>""",
    """<a>no target</a><a href="">self</a>""",
    "",
)


@query("""WITH p AS (SELECT page_id, page_id % 8 AS k, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^[^?#]+', 0) AS bare, html FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'https://pub.example.com/story/' || page_id WHEN 1 THEN scheme || '//cdn.example.org/' || page_id WHEN 2 THEN CASE WHEN ends_with(bare, '/') THEN regexp_replace(bare, '[^/]+/$', '') ELSE root || '/' END || 'up/' || page_id || '?a=1&b=2'
  WHEN 3 THEN bare || '?q=' || page_id WHEN 4 THEN CASE scheme WHEN 'https:' THEN 'https' ELSE 'HTTPS' END || '://Other.example.com/' || page_id WHEN 5 THEN root || '/root/' || page_id WHEN 6 THEN url ELSE root || regexp_extract(html, '<a href="([^"]+)"', 1) END AS publisher_url FROM p WHERE k < 7 OR contains(html, '<a href="')""")
def op_c4_publisher_links(spark, d):
    """Links before every page's own, of eight kinds: attributes in any order and quoting, entities, references of every form, aggregators, unsafe targets, comments and scripts; without one, the page's own anchors."""
    p = table(spark, d, "pages")
    kinds = F.array(*(F.replace(F.lit(k), F.lit("{0}"), F.col("page_id").cast("string")) for k in _LINK_KINDS))
    return pg.publisher_links(p, "page_id", F.concat(F.element_at(kinds, (F.col("page_id") % 8 + 1).cast("int")), F.col("html")), F.col("url"))


def _enriched(spark, d):
    a = views.page_articles(spark, d)
    ends = F.when(F.col("page_id") % 15 == 2, "timeout").when(F.col("page_id") % 15 == 5, "http_error").when(F.col("page_id") % 15 == 8, "parse_error").otherwise("success")
    ev = _evidence(spark, d)
    resolved = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://pub.example.com/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 5 == 1, F.lit("https://news.google.com/articles/x"))
    ev = ev.select(F.col("page_id").alias("seq"), F.when(F.col("page_id") % 11 != 0, F.col("evidence")).alias("evidence"), "tier", resolved.alias("resolved_url"), ends.alias("fetch_status"))
    return pg.enriched(a.select("seq", "url"), a.where("seq % 3 <> 0").select("seq"), a.where("seq % 3 = 1").select("seq"), ev)


_ENRICHED = "SELECT page_id AS seq, url, CASE page_id % 3 WHEN 0 THEN 'no_owner' WHEN 1 THEN 'not_needed' ELSE CASE page_id % 15 WHEN 2 THEN 'timeout' WHEN 5 THEN 'http_error' WHEN 8 THEN 'parse_error' ELSE CASE WHEN page_id % 11 = 0 THEN 'insufficient_content' ELSE 'success' END END END AS status FROM pages"


@query(f"SELECT seq, status, CASE WHEN seq % 3 = 2 THEN 'article_tag' END AS tier FROM ({_ENRICHED})")
def op_c5_enrichment(spark, d):
    return _enriched(spark, d).select("seq", "status", "tier")


@query(f"""SELECT count(*) AS articles, count(*) FILTER (seq % 3 = 2) AS candidates, count(*) FILTER (seq % 3 = 1) AS skipped, count(DISTINCT CASE WHEN seq % 3 = 2 THEN lower(k.canonical_url) END) AS attempted, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'timeout') AS timeout,
  count(*) FILTER (status = 'http_error') AS http_error, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'parse_error') AS parse_error, count(*) FILTER (status = 'insufficient_content') AS insufficient_content, count(*) FILTER (status = 'success' AND seq % 2 = 0) AS resolved_urls,
  count(*) FILTER (seq % 3 = 2) - count(DISTINCT CASE WHEN seq % 3 = 2 THEN lower(k.canonical_url) END) AS cache_hits, coalesce(sum(seq % 4) FILTER (status = 'not_needed'), 0)::BIGINT AS matches_before, coalesce(sum(seq % 3 + 1) FILTER (status = 'success' AND seq % 2 = 0), 0)::BIGINT AS matches_after
  FROM ({_ENRICHED}) e JOIN (WITH {CANON} SELECT page_id, canonical_url FROM k) k ON k.page_id = e.seq""")
def op_c6_enrichment_counters(spark, d):
    """Every counter; numbers of matches are made from the page's."""
    rows = _enriched(spark, d)
    before, after = rows.select("seq", (F.col("seq") % 4).alias("n")), rows.where("seq % 2 = 0").select("seq", (F.col("seq") % 3 + 1).alias("n"))
    return pg.enrichment_counters(rows, before, after)


@query("SELECT c_custkey FROM customer ORDER BY sha256('smoke|' || c_name), c_name LIMIT 25")
def op_e5_hashed_sample(spark, d):
    return hashed_sample(table(spark, d, "customer"), "c_name", 25, "smoke").select("c_custkey")


@query("SELECT doc_id, contains(lower(source), 'src1') AS repost FROM documents")
def op_d7_reposts(spark, d):
    a = views.document_articles(spark, d)
    source = F.when(F.col("source").contains("src1"), F.lit("Naver Blog")).otherwise(F.col("source"))
    return a.select(F.col("seq").alias("doc_id"), t.is_repost(F.lit("title"), source, F.col("url")).alias("repost"))
