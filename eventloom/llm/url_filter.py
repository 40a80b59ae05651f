"""URL filter by rules and by the empirical-Bayes reputation of hosts, with DataFrame operations only.

A url's rule is the longest that fits: its host or a parent domain of it is the rule's, and the path starts with the rule's. Where no rule fits, the host's reputation decides. Labelled outcomes of pages (bad
or not) are counted by host, registered domain and suffix. A host's rate of bad pages has a beta prior whose mean is the shrunken rate of its registered domain's other hosts; that rate has a prior from the
suffix's other domains, and that one from all other suffixes. So every outcome counts once for a host. How firmly a level holds to the one above (the prior's weight in pages) is estimated
from the spread of the level's rates by the beta-binomial's moments. A host is blocked if the lower bound of its posterior exceeds `most_bad`: few or mixed outcomes block nothing.

The bound is that of the normal approximation on the logit scale: logit(a/b) - z sqrt(1/a + 1/b) for the posterior Beta(a, b).

Outcomes are aggregated map-side, so a host of any size costs a task one row; hosts, domains and suffixes that hold many rows are broadcast to them (`attach`). The driver gets totals and three weights.

Defined results: a null url or one without `://` has empty host and path, no rule, and the reputation of the host ''. Of a page id that outcomes repeat, the worst counts; a null outcome or a null page id counts nothing. Rows
that repeat a page are each an outcome. For reputations a host loses user, port and final dots; an IP address is its own registered domain, with suffix `ip`. No page at all: an empty result. Clashing columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import attach, discard, stored, table

#: The contract's rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of two labels under which names are registered (a parameter; every other suffix is the last label).
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "go.kr", "com.br", "com.cn", "com.tw", "co.in", "co.nz", "co.za", "com.mx")
#: A host is blocked if its rate of bad pages exceeds MOST_BAD with one-sided 95 % probability.
MOST_BAD, Z = 0.5, 1.6449
#: Bounds of a prior's weight in pages, and the weight where nothing can be learned about it.
WEIGHTS, UNKNOWN_WEIGHT = (1.0, 1000.0), 10.0
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_name(host: Column) -> Column:
    """Without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@|:[0-9]*$", ""), r"\.+$", "")


def with_domain(hosts: DataFrame, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """hosts(name, ...) with registered domain and suffix."""
    labels, address = F.split("name", r"\."), F.col("name").rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.lit(1) * k), ".")
    long = last(F.lit(2)).isin(*long_suffixes)
    return hosts.withColumn("domain", F.when(address, F.col("name")).when(long, last(F.lit(3))).otherwise(last(F.lit(2)))).withColumn("suffix", F.when(address, "ip").when(long, last(F.lit(2))).otherwise(last(F.lit(1))))


def prior_weight(children: DataFrame) -> float:
    """Weight of the prior, in outcomes, of children(n, bad, mean): 1/rho - 1 for the correlation rho of outcomes within a child, by the moments of the beta-binomial."""
    n, p = F.col("n"), F.col("mean")
    spread, chance, pairs = F.pow(F.col("bad") - n * p, F.lit(2)), n * p * (1 - p), n * (n - 1) * p * (1 - p)
    r = children.agg(F.sum(spread - chance).alias("excess"), F.sum(pairs).alias("pairs")).first()
    if not r.pairs:
        return UNKNOWN_WEIGHT
    rho = min(max(r.excess / r.pairs, 1 / (WEIGHTS[1] + 1)), 1 / (WEIGHTS[0] + 1))
    return 1 / rho - 1


def shrunk(weight: float, n: Column, bad: Column, mean: str = "mean") -> Column:
    """Posterior mean of a parent's rate by its outcomes outside of the child, under the prior of its own parent."""
    return (F.lit(weight) * F.col(mean) + bad) / (F.lit(weight) + n)


def reputations(pages: DataFrame, outcomes: DataFrame, long_suffixes: tuple[str, ...] = LONG_SUFFIXES, z: float = Z) -> DataFrame:
    """pages(page_id, name), outcomes(page_id, bad: 0/1, n: 1) one a page -> (name, rows, n, bad, rate, low) for every host name: rate is the posterior mean, low its lower bound."""
    told = pages.join(outcomes, "page_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    hosts = stored(with_domain(told.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), total("n"), total("bad")), long_suffixes), "url-hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(total("n"), total("bad"), F.count(F.lit(1)).alias("hosts")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(total("n"), total("bad"), F.count(F.lit(1)).alias("domains"), F.sum("hosts").alias("hosts"))
    every = suffixes.agg(total("n"), total("bad"), total("domains"), total("hosts")).first()
    own = lambda df, *keys: df.select(*keys, "n", "bad", "mean")
    renamed = lambda df, name, weight: df.select(name, F.col("n").alias("up_n"), F.col("bad").alias("up_bad"), F.col("mean").alias("up_mean"), weight)

    top = stored(suffixes.withColumn("mean", (F.lit(every.bad) - F.col("bad") + 1) / (F.lit(every.n) - F.col("n") + 2)), "url-suffixes")
    weight = prior_weight(own(top, "suffix"))
    middle = attach(domains, renamed(top, "suffix", "domains"), "suffix", "domains", every.domains)
    middle = stored(middle.withColumn("mean", shrunk(weight, F.col("up_n") - F.col("n"), F.col("up_bad") - F.col("bad"), "up_mean")).select("domain", "n", "bad", "mean", "hosts"), "url-means")
    weight = prior_weight(own(middle, "domain"))
    low = attach(hosts, renamed(middle, "domain", "hosts"), "domain", "hosts", every.hosts)
    low = stored(low.withColumn("mean", shrunk(weight, F.col("up_n") - F.col("n"), F.col("up_bad") - F.col("bad"), "up_mean")).select("name", "rows", "n", "bad", "mean"), "url-reputations")
    weight = prior_weight(low)
    discard(hosts, domains, top, middle)
    a, b = F.lit(weight) * F.col("mean") + F.col("bad"), F.lit(weight) * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    return low.select("name", "rows", "n", "bad", (a / (a + b)).alias("rate"), (1 / (1 + F.exp(F.lit(z) * F.sqrt(1 / a + 1 / b) - F.ln(a / b)))).alias("low"))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), or null. rules: (verdict, host, path), a list short enough for an expression."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    return F.array_max(F.filter(F.array(*(F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules)), lambda r: r.isNotNull()))


def url_filter(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, most_bad: float = MOST_BAD, long_suffixes: tuple[str, ...] = LONG_SUFFIXES, z: float = Z) -> DataFrame:
    """(id_col, host, path, rule, verdict, labelled, bad_rate, bad_low) of every page. outcomes(id_col, bad boolean): labelled pages."""
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("name", host_name(F.col("host")))
    known = outcomes.select(F.col(id_col).alias("page_id"), F.col("bad").cast("int").alias("bad")).dropna().groupBy("page_id").agg(F.max("bad").alias("bad"), F.lit(1).alias("n"))
    hosts = stored(reputations(parts.select("page_id", "name"), known, long_suffixes, z), "url-verdicts")
    met = attach(parts, hosts, "name", "rows", pages.count())
    ruled = met.withColumn("ruled", fitting_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    judged = F.coalesce(F.col("ruled.verdict"), F.when(F.col("low") > most_bad, "block").otherwise("allow"))
    return ruled.select(F.col("page_id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), judged.alias("verdict"), F.col("n").alias("labelled"), F.round("rate", 6).alias("bad_rate"), F.round("low", 6).alias("bad_low"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables label documents only, so a page's outcome is that of the document of its number: bad if its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes)


_FIT = "1.0 / least(greatest(CASE WHEN coalesce(sum(n * (n - 1) * mean * (1 - mean)), 0) = 0 THEN 1.0 / 11 ELSE sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean)) END, 1.0 / 1001), 1.0 / 2) - 1"
OP12_SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_CAPITALS}', '{_SMALL}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
w AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.+$', '') AS name FROM u),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT name, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, string_split(name, '.') AS l FROM w LEFT JOIN o USING (page_id) GROUP BY name),
h AS (SELECT name, n, bad, array_to_string(l[-2:], '.') AS domain, l[-1] AS suffix FROM c),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, ((SELECT sum(bad) FROM h) - sum(bad) + 1) / ((SELECT sum(n) FROM h) - sum(n) + 2) AS mean FROM d GROUP BY suffix),
k1 AS (SELECT {_FIT} AS k FROM s),
dm AS (SELECT d.domain, d.n, d.bad, (k * s.mean + s.bad - d.bad) / (k + s.n - d.n) AS mean FROM d JOIN s USING (suffix), k1),
k2 AS (SELECT {_FIT} AS k FROM dm),
hm AS (SELECT h.name, h.n, h.bad, (k * dm.mean + dm.bad - h.bad) / (k + dm.n - h.n) AS mean FROM h JOIN dm USING (domain), k2),
k3 AS (SELECT {_FIT} AS k FROM hm),
ab AS (SELECT name, n, k * mean + bad AS a, k * (1 - mean) + n - bad AS b FROM hm, k3),
r(v, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT w.page_id, w.host, w.path, f.rule, coalesce(f.v, CASE WHEN 1 / (1 + exp({Z} * sqrt(1 / a + 1 / b) - ln(a / b))) > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict, ab.n::BIGINT AS labelled,
  round(a / (a + b), 6) AS bad_rate, round(1 / (1 + exp({Z} * sqrt(1 / a + 1 / b) - ln(a / b))), 6) AS bad_low
FROM w JOIN ab USING (name) LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM w.page_id AND f.host = w.host AND f.path = w.path
"""
