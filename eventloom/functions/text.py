"""Text, URL, hash and date columns. NFKC with case folding, HTML unescaping and span tests are Arrow UDFs; all else is built in."""

from __future__ import annotations

import html
import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Legal forms, tracking parameters, aggregator hosts, low-quality markers.
LEGAL_KEY_SUFFIX = r"(?:\(주\)|주식회사|inc\.?|ltd\.?|limited)$"
LEGAL_PREFIX = r"(?i)^(?:\(주\)|㈜|주식회사)\s*"
LEGAL_SUFFIX = r"(?i)(?:\s*(?:\(주\)|㈜|주식회사|,?\s*Pte\.?\s*Ltd\.?|,?\s*GmbH|,?\s*LLC|,?\s*LLP|,?\s*PLC|,?\s*Inc\.?|,?\s*Ltd\.?|\s+Limited)[ ,.]*)+$"
FORMER_NAME = r"(?i)\(구\s*[,.]\s*(.+)\)\s*$"
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
AGGREGATOR_HOSTS = ("news.google.com", "google.com", "www.google.com")
REPOST_MARKERS = ("naver blog", "네이버 블로그", "blog.naver.com", "tistory", "티스토리")
#: Filler phrases of watchpoints.
FILLER = (
    "귀추가 주목된다", "긍정적 영향", "부정적 영향", "기업가치 상승 기대", "경쟁력 강화 전망",
    "성장이 기대된다", "큰 도움이 될 전망", "지켜볼 필요가 있다", "향후 상황을 지켜",
)
#: Zone names of RFC 2822 and their hours from UTC; page status codes that mean blocked; status names of feeds.
ZONE_HOURS = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
BLOCKED_CODES = (401, 403, 407, 429, 451)
RETRIED_CODES = (429, 502, 503, 504)
TRANSIENT_STATUSES = ("rate_limited", "service_unavailable", "timeout", "connection_error")
#: White space of Unicode; the JVM's own classes know ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WORD = r"[^\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_casefold_squeezed(s: pd.Series) -> pd.Series:
    """White space of Unicode (as in SPACE) collapsed to blanks as well: as a function of its own, so that a column that many expressions read isn't worked out in each of them."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(BooleanType())
def public_address(host: pd.Series) -> pd.Series:
    """False for an IP address that isn't publicly routable; True for names and public addresses."""

    def public(x: str) -> bool:
        try:
            a = ipaddress.ip_address(x.strip("[]"))
        except ValueError:
            return True
        return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast)

    return host.map(public, na_action="ignore")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def url_host(url: Column) -> Column:
    """The host of any URL with a scheme, lower-cased, without port and brackets, whatever characters it has; null where there is none."""
    place = F.substring_index(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "@", -1)
    return F.lower(F.nullif(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1)), F.lit("")))


def canonical_url(url: Column) -> Column:
    """B1: no fragment, no tracking parameters; other parameters in order, re-encoded; a bare name gets an empty value."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.substring_index(bare, "?", 1)
    query = F.when(F.instr(bare, "?") > 0, F.substring(bare, F.length(head) + 2, F.length(bare))).otherwise("")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    coded = lambda x: F.replace(F.url_encode(F.try_url_decode(x)), F.lit("*"), F.lit("%2A"))
    pair = F.transform(params, lambda p: F.concat(F.coalesce(coded(F.substring_index(p, "=", 1)), p), F.lit("="), F.when(F.instr(p, "=") > 0, F.coalesce(coded(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.lit(""))).otherwise("")))
    return F.when(F.size(params) > 0, F.concat(head, F.lit("?"), F.array_join(pair, "&"))).otherwise(head)


def query_key(c: Column) -> Column:
    """B2."""
    return nfkc_casefold_squeezed(c)


def plain_text(c: Column) -> Column:
    """Entities first, tags to a blank, blanks collapsed, nothing left is null."""
    return F.nullif(squeezed(F.regexp_replace(html_unescape(c), "<[^>]+>", " ")), F.lit(""))


def publisher_name(title: Column, name: Column, default: str = "Unknown") -> Column:
    """B4."""
    return F.coalesce(F.nullif(stripped(title), F.lit("")), F.nullif(stripped(name), F.lit("")), F.lit(default))


def published_at(c: Column) -> Column:
    """RFC 2822 to UTC, with or without weekday and seconds; years of two digits are 1969 to 2068; no zone, or one of an unknown name, means UTC. ISO times as well."""
    part = lambda k: F.regexp_extract(stripped(c), r"^(?:[A-Za-z]+,?\s*)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(.*)$", k)
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) > "68", "19").otherwise("20"), part(3)))
    told = F.concat_ws(" ", part(1), F.initcap(part(2)), year, F.concat_ws(":", part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))), F.lit("+0000"))
    zone = F.regexp_extract(part(7), r"^([+-])(\d{2})(\d{2})", 0)
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ZONE_HOURS.items() for x in p)), F.upper(F.regexp_extract(part(7), "^[A-Za-z]+", 0))), F.lit(0)) * 60
    minutes = F.when(zone != "", F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(named)
    rfc = F.try_to_timestamp(told, F.lit("d MMM yyyy H:mm:ss Z")) - F.make_dt_interval(mins=minutes)
    return F.coalesce(rfc, F.try_to_timestamp(stripped(c), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def title_key(c: Column) -> Column:
    """Title fingerprint; underscores stay."""
    return F.trim(F.regexp_replace(nfkc_casefold(c), NOT_WORD, " "))


def identity_key(c: Column) -> Column:
    """Company identity without blanks and one legal suffix."""
    return F.btrim(F.regexp_replace(F.regexp_replace(nfkc_casefold(c), f"{SPACE}+", ""), LEGAL_KEY_SUFFIX, ""), F.lit(" ,."))


def source_name(c: Column) -> Column:
    """struct(current, former, malformed)."""
    value = stripped(nfkc(c))
    former = stripped(F.regexp_extract(value, FORMER_NAME, 1))
    has = value.rlike(FORMER_NAME)
    current = F.when(has, stripped(F.regexp_replace(value, FORMER_NAME, ""))).otherwise(value)
    return F.struct(current.alias("current"), F.when(has, former).alias("former"), (has & ((current == "") | (former == ""))).alias("malformed"))


def display_name(c: Column) -> Column:
    """Prefix once, then suffixes until none is left; the name itself where nothing would be left."""
    bare = F.btrim(F.regexp_replace(stripped(F.regexp_replace(c, LEGAL_PREFIX, "")), LEGAL_SUFFIX, ""), F.lit(" ,."))
    return F.coalesce(F.nullif(bare, F.lit("")), stripped(c))


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def company_id(name: Column) -> Column:
    """B10."""
    return F.concat(F.lit("company-"), short_hash(identity_key(name)))


def instant_text(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss[.ffffff]+00:00, or None."""
    micros = F.date_format(ts, ".SSSSSS")
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00")), F.lit("None"))


def article_id(url: Column, title: Column, ts: Column) -> Column:
    """B11; url is folded here."""
    return short_hash(F.concat_ws("|", nfkc_casefold_only(url), title_key(title), instant_text(ts)))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def nfkc_casefold_only(c: Column) -> Column:
    return casefold(stripped(c))


#: First parts of event ids by route.
EVENT_ROUTES = {"direct": "route_a", "external": "route_b"}


def event_id(company: Column | None, ids: Column, route: str = "direct") -> Column:
    """Company None for cross-company events; ids are the member ids."""
    parts = [F.lit(EVENT_ROUTES[route])] + ([company] if company is not None else [])
    return short_hash(F.concat_ws("|", *parts, F.array_join(F.array_sort(ids), "|")))


def labelled_event_hash(company: Column, label: Column) -> Column:
    """The hash of an event that has a label: its first 16 digits are the event's id, all of it the event's fingerprint."""
    return F.sha2(F.concat_ws("|", company, casefold(label)), 256)


def link_id(*parts: Column) -> Column:
    """B13."""
    return short_hash(F.concat_ws("|", *parts))


def candidate_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def distinct_terms(terms: Column, keys: Column) -> Column:
    """First of each key, in order; keys are the folded terms."""
    return F.filter(terms, lambda t, i: (F.trim(t) != "") & (F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))


def short_ascii(c: Column) -> Column:
    """An ASCII name of at most five characters, or with a word of at most three."""
    return c.rlike(r"^[\x00-\x7F]+$") & ((F.length(c) <= 5) | F.exists(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) <= 3))


def safe_url(url: Column) -> Column:
    """http(s), a host, no credentials, not local, not a private or reserved address."""
    host = url_host(url)
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.nullif(F.translate(F.when(F.instr(place, "@") > 0, F.regexp_replace(place, "@[^@]*$", "")).otherwise(""), ":", ""), F.lit(""))
    local = host.isin("localhost", "localhost.localdomain") | host.endswith(".local")
    return F.coalesce(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https") & host.isNotNull() & user.isNull() & ~local & public_address(host), F.lit(False))


def is_aggregator(url: Column) -> Column:
    """B17, first half."""
    host = F.coalesce(url_host(url), F.lit(""))
    return host.isin(*AGGREGATOR_HOSTS) | host.endswith(".google.com")


def wrapper_target(url: Column) -> Column:
    """B17, second half: the wrapper's reader route instead of its feed route."""
    feed = url_host(url).eqNullSafe("news.google.com") & F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).startswith("/rss/articles/")
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/rss/articles/", "/articles/")
    kept = F.array_join(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin("hl", "gl", "ceid")), "&")
    query = F.concat(F.when(kept != "", F.concat(kept, F.lit("&"))).otherwise(""), F.lit("hl=en-US&gl=US&ceid=US%3Aen"))
    return F.when(feed, F.concat(F.substring_index(bare, "?", 1), F.lit("?"), query)).otherwise(url)


def title_clause(title: Column, terms: Column) -> Column:
    """Of the clauses parted by ; or |, the one with most terms (array), the first of ties; without a hit the first."""
    clauses = F.filter(F.transform(F.split(title, r"[;|]"), lambda c: F.trim(c)), lambda c: c != "")
    ranked = F.transform(clauses, lambda c, i: F.struct((-F.size(F.filter(terms, lambda t: (t != "") & F.contains(F.lower(c), F.lower(t))))).alias("hits"), i.alias("i"), c.alias("clause")))
    return F.coalesce(F.array_min(ranked)["clause"], F.trim(title))


def relative_age(ts: Column, as_of: Column) -> Column:
    """B19."""
    s = F.greatest(F.unix_timestamp(as_of) - F.unix_timestamp(ts), F.lit(0))
    say = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(ts.isNull(), F.lit(None)).when(s < 60, "now").when(s < 3600, say(60, "m ago")).when(s < 86400, say(3600, "h ago")).otherwise(say(86400, "d ago"))


def lead_text(text: Column, description: Column, n: int = 1400) -> Column:
    """Empty text counts as missing."""
    return F.substring(F.coalesce(F.nullif(text, F.lit("")), description, F.lit("")), 1, n)


def match_fold(c: Column) -> Column:
    """B21."""
    return F.translate(nfkc_casefold(c), "–—", "--")


def feed_outcome(code: Column, error: Column) -> Column:
    """B22 of a feed: struct(status, transient: worth another try, signal: counts for the failure alarm J8)."""
    e = F.lower(F.coalesce(error, F.lit("")))
    late, cut = e.contains("timeout") | e.contains("timed out"), e.contains("connect")
    status = F.when(code == 429, "rate_limited").when(code == 503, "service_unavailable").when(code >= 400, "http_error").when(cut, "connection_error").when(late, "timeout").when(e != "", "http_error").otherwise("success")
    transient = F.coalesce(code.isin(*RETRIED_CODES), F.lit(False)) | (F.coalesce(code < 400, F.lit(True)) & (late | cut))
    return F.struct(status.alias("status"), transient.alias("transient"), status.isin(*TRANSIENT_STATUSES).alias("signal"))


def page_outcome(code: Column, error: Column) -> Column:
    """B22 of a page: status of a fetch by its code or the kind of its error."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e.contains("timeout") | e.contains("timed out"), "timeout").when(code.isin(*BLOCKED_CODES), "blocked").when(code >= 400, "http_error").when(e.contains("parse"), "parse_error").when(e != "", "http_error").otherwise("success")


def stage_reason(code: Column, error: Column, stage: str) -> Column:
    """B22 of a model stage: struct(reason, retryable); the first match wins."""
    e = F.lower(F.coalesce(error, F.lit("")))
    says = lambda *words: F.greatest(F.lit(False), F.lit(False), *(e.contains(w) for w in words))
    of = lambda test: F.coalesce(test, F.lit(False))
    reason = (
        F.when(says("timeout"), f"{stage}_timeout").when(of(code == 429) | says("429"), f"{stage}_429_exhausted").when(of(code >= 500) | says("5xx", "server error"), f"{stage}_5xx_exhausted")
        .when(says("schema", "malformed", "unexpected", "violates"), f"{stage}_schema_failure").otherwise(f"{stage}_client_error")
    )
    return F.struct(reason.alias("reason"), (of(code == 429) | of(code >= 500) | says("429", "5xx", "server error", "connection", "timeout")).alias("retryable"))


def is_repost(*parts: Column) -> Column:
    """D7."""
    return F.lower(F.concat_ws(" ", *parts)).rlike("|".join(re.escape(m) for m in REPOST_MARKERS))


def has_filler(c: Column, phrases: tuple[str, ...] = FILLER) -> Column:
    """D8."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(c), p))


def source_class(url: Column, source: Column, redirect: Column | None = None) -> Column:
    """H14. The marker lists."""
    u, s = F.lower(url), F.lower(source)
    host = F.coalesce(url_host(u), F.lit(""))  # three patterns: so it is mentioned as seldom as can be
    has = lambda c, marks: F.coalesce(c.rlike("|".join(map(re.escape, marks))), F.lit(False))
    aggregators = ("news.google", "google.com", "yahoo", "msn.com", "newsbreak", "feedproxy", "feedburner")
    record = has(u, (".gov", ".go.kr", "sec.gov", "dart.fss", "fda.gov", "ema.europa.eu", "ir.", "newsroom", "investor"))  # a host is part of its url
    aggregator = has(host, aggregators) | has(s, aggregators)
    if redirect is not None:
        aggregator = aggregator | F.coalesce(redirect != "", F.lit(False))
    return F.when(record, "source_of_record").when(aggregator, "aggregator_or_low_information").when(host != "", "direct_publisher").otherwise("unknown_publisher")
