"""Input views that Spark derives from the given tables: articles, headlines, terms, outcomes, decisions and ranked items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.shared import small_batches, told_parts

#: Tables of whole texts.
LONG = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Whole texts go to Python in small batches, so that a worker's memory doesn't hang on how many rows a task has."""
    if name in LONG:
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt out by customer: a file of few row groups has few reading tasks, however many rows it has, and what is derived from an order takes a hundred times its reading. The number of parts is told, else adaptive execution
    merges them by their bytes to a few again."""
    return table(spark, sf_dir, "orders").repartition(told_parts(spark), "o_custkey")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per page; published_at steps by 37 minutes from a fixed start."""
    p = table(spark, sf_dir, "pages")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return p.select(
        F.col("page_id").alias("seq"), "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("source"),
        (start + F.make_dt_interval(mins=(F.col("page_id") * 37).cast("int"))).alias("published_at"), "html",
    )


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document: the text's first line is the title, all the rest the description; two documents whose ids follow each other share a url."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("seq"), title.alias("title"), F.substring(F.col("text"), F.char_length(title) + 2, F.char_length("text")).alias("description"), "text", "lang", "source", F.concat(F.lit("https://news.example.com/story/"), F.expr("doc_id div 2").cast("string")).alias("url"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event headlines of orders; every third order is told twice, in other words, at another url, five hours later."""
    o, c, n = dealt_orders(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    verb = F.element_at(F.array(*map(F.lit, ("raises", "acquires", "signs contract", "launches", "announces partnership"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    body = F.concat(F.col("c_name"), F.lit(" "), verb, F.lit(" $"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(" million with "), F.replace("n_name", F.lit("_"), F.lit("-")), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = o.withColumn("o_orderdate", F.add_months("o_orderdate", 240).cast("timestamp"))  # two decades later: the fact patterns know this century's dates
    base = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "c_name", "n_name", "o_orderdate", body.alias("body"))
    told = base.select("*", F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return told.select(
        (F.col("o_orderkey") * 2 + F.col("copy")).alias("seq"), F.col("c_name").alias("company"), F.when(F.col("copy") == 0, F.col("body")).otherwise(F.concat(F.lit("Report: "), F.col("body"), F.lit(" says source"))).alias("title"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("The desk for "), F.col("n_name"), F.lit(" has the details of this event and its terms."))).alias("description"), F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, ("wire.example.net", "newsroom.example.com", "yahoo.example.com"))), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("/"), F.col("copy").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("desk "), (F.col("o_orderkey") % 7).cast("string")).alias("source"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 96 + 5 * F.col("copy")).cast("int"))).cast("timestamp").alias("published_at"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), "o_orderkey", "o_custkey", "copy", "n_name",
    )


def feed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of fetches: errors failed, with codes by id."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    code = F.when(failed, F.element_at(F.array(*map(F.lit, (429, 503, 500, 404, 0))), (F.col("event_id") % 5 + 1).cast("int"))).otherwise(200)
    return e.select("event_id", "ts", "user_id", F.when(code > 0, code).alias("http_status"), F.when(failed & (F.col("event_id") % 5 == 4), F.lit("read timed out")).alias("error"), (F.col("user_id") % 7).alias("retry_attempts"), "value", "event_type")


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as items: route by parity, materiality by priority, one or two companies; every ninth order shares its fingerprint with the one before."""
    h = headlines(spark, sf_dir)
    other = F.concat(F.lit("Customer#"), F.lpad(((F.col("o_custkey") + 1) % 150).cast("string"), 9, "0"))
    return h.select(
        F.col("seq").alias("item_id"), F.when(F.col("o_orderkey") % 2 == 0, "direct").otherwise("external").alias("route"), F.when(F.col("level") <= 2, "high").when(F.col("level") == 3, "medium").otherwise("low").alias("materiality"),
        "published_at", "company", "title", F.when(F.col("o_orderkey") % 5 == 0, F.array("company", other)).otherwise(F.array("company")).alias("companies"), F.lit("event").alias("kind"), F.floor(F.col("o_orderkey") / 2).cast("string").alias("fingerprint"),
    )


def sent_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth fingerprint has been sent."""
    return ranked_items(spark, sf_dir).where(F.col("fingerprint").cast("long") % 5 == 0).select("kind", "fingerprint").distinct()


#: The same views for DuckDB.
HEADLINES_SQL = """
b AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 20 YEAR AS o_orderdate, c_name, n_name, CAST(left(o_orderpriority, 1) AS INTEGER) AS level,
        c_name || ' ' || ['raises', 'acquires', 'signs contract', 'launches', 'announces partnership'][CAST(left(o_orderpriority, 1) AS INTEGER)] || ' $' || CAST(floor(o_totalprice / 1000) AS BIGINT) || ' million with ' || replace(n_name, '_', '-') || ' on ' || strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS body
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT o_orderkey * 2 + copy AS seq, c_name AS company, CASE WHEN copy = 0 THEN body ELSE 'Report: ' || body || ' says source' END AS title,
        CASE WHEN o_orderkey % 2 = 0 THEN 'The desk for ' || n_name || ' has the details of this event and its terms.' END AS description,
        'https://' || ['wire.example.net', 'newsroom.example.com', 'yahoo.example.com'][o_orderkey % 3 + 1] || '/' || copy || '/' || o_orderkey AS url,
        'desk ' || (o_orderkey % 7) AS source, o_orderdate + to_hours(CAST(o_orderkey % 96 + 5 * copy AS INTEGER)) AS published_at, level, o_orderkey, o_custkey, copy, n_name
      FROM b, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR o_orderkey % 3 = 0)"""
ITEMS_SQL = (
    HEADLINES_SQL
    + """,
i AS (SELECT seq AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'direct' ELSE 'external' END AS route, CASE WHEN level <= 2 THEN 'high' WHEN level = 3 THEN 'medium' ELSE 'low' END AS materiality, published_at, company, title,
        CASE WHEN o_orderkey % 5 = 0 THEN [company, 'Customer#' || lpad(CAST((o_custkey + 1) % 150 AS VARCHAR), 9, '0')] ELSE [company] END AS companies, 'event' AS kind, CAST(o_orderkey // 2 AS VARCHAR) AS fingerprint,
        CASE (CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'e' END) || CASE WHEN level <= 2 THEN 'h' WHEN level = 3 THEN 'm' ELSE 'l' END WHEN 'dh' THEN 0 WHEN 'eh' THEN 1 WHEN 'dm' THEN 2 WHEN 'dl' THEN 3 WHEN 'em' THEN 4 ELSE 5 END AS priority FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY priority, published_at DESC NULLS LAST, lower(company), lower(title), item_id) AS rank FROM i)"""
)
OUTCOMES_SQL = """
f AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 4 THEN NULL ELSE [429, 503, 500, 404, 0][event_id % 5 + 1] END AS http_status,
        CASE WHEN event_type <> 'error' THEN 'success' ELSE ['rate_limited', 'service_unavailable', 'http_error', 'http_error', 'timeout'][event_id % 5 + 1] END AS status,
        event_type = 'error' AND event_id % 5 NOT IN (2, 3) AS transient, user_id % 7 AS retry_attempts, value, event_type FROM events)"""
