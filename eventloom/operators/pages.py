"""Evidence text from landed pages, publisher links of wrapper pages, need-based enrichment."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from eventloom.functions.text import canonical_url, is_aggregator, safe_url

#: Limits, marker of page chrome, tags that carry no article text, tags without an end.
MOST, LEAST = 20_000, 20
CHROME = re.compile(r"(?:related|recommended|recommendation|footer|sidebar|navigation|breadcrumb|promo|advert|outbrain|taboola)", re.I)
UNWANTED = {"script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
METAS = {"og:title": "property", "og:description": "property", "description": "name", "twitter:title": "name", "twitter:description": "name"}
ARTICLE_TYPES = {"article", "newsarticle", "reportagenewsarticle"}


class _Page(HTMLParser):
    """One pass over a page: title, metas, JSON-LD scripts, and the text of the first article and main elements without chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.metas, self.scripts = None, {}, []
        self.parts = {"article": [], "main": []}
        self.state = {"article": 0, "main": 0}  # 0 not met, 1 open, 2 closed
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            for key, attribute in METAS.items():  # the first tag of each key counts, with or without content
                if a.get(attribute) == key and key not in self.metas:
                    self.metas[key] = a.get("content")
        if tag == "script" and re.search(r"application/ld\+json", a.get("type") or "", re.I):
            self.scripts.append("")
        if tag in VOID:
            return
        marks = " ".join((a.get("id") or "", a.get("class") or "", a.get("role") or "", a.get("aria-label") or ""))
        inside = 1 in self.state.values()
        hides = tag in UNWANTED or (inside and bool(CHROME.search(marks)))
        self.stack.append((tag, hides))
        self.hidden += hides
        if tag in self.state and self.state[tag] == 0:
            self.state[tag] = 1

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, hides = self.stack.pop()
            self.hidden -= hides
            if t in self.state and self.state[t] == 1 and not any(x == t for x, _ in self.stack):
                self.state[t] = 2
            if t == tag:
                break

    def handle_data(self, data):
        top = self.stack[-1][0] if self.stack else ""
        if top == "title" and self.title is None:
            self.title = data
        if top == "script" and self.scripts and not self.scripts[-1]:
            self.scripts[-1] = data
        if not self.hidden and data.strip():
            for tag, s in self.state.items():
                if s == 1:
                    self.parts[tag].append(data.strip())


def jsonld_articles(value) -> Iterator[dict]:
    """Article objects in lists and @graph."""
    if isinstance(value, list):
        for x in value:
            yield from jsonld_articles(x)
    elif isinstance(value, dict):
        if value.get("@graph") is not None:
            yield from jsonld_articles(value["@graph"])
        kinds = value.get("@type", [])
        if any(str(k).casefold() in ARTICLE_TYPES for k in ([kinds] if isinstance(kinds, str) else kinds)):
            yield value


def evidence(page: str | None) -> tuple[str | None, str | None]:
    """(text, tier) of one page; (None, None) where no tier has enough."""
    if not page:
        return None, None
    p = _Page()
    p.feed(page)
    p.close()
    meta = ([p.title] if p.title else []) + [p.metas[k] for k in METAS if p.metas.get(k) is not None]
    tidy = lambda parts: " ".join(" ".join(parts).split())[:MOST]
    said = []
    for raw in p.scripts:
        try:
            for a in jsonld_articles(json.loads(raw)):
                said += [a[k] for k in ("headline", "description", "articleBody") if isinstance(a.get(k), str) and a[k].strip()]
        except ValueError:
            continue
    if said and len(text := tidy([*meta, *said])) >= LEAST:
        return text, "jsonld"
    for tag in ("article", "main"):
        if p.state[tag] and len(text := tidy([*meta, *p.parts[tag]])) >= LEAST:
            return text, f"{tag}_tag"
    text = tidy(meta)
    return (text, "opengraph") if len(text) >= LEAST and len(meta) >= 2 else (None, None)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, evidence, tier), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [evidence(x) for x in b["html"]]
            yield pd.DataFrame({"id": b["id"], "evidence": [g[0] for g in got], "tier": [g[1] for g in got]})

    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, evidence string, tier string").withColumnRenamed("id", id_col)


class _Links(HTMLParser):
    """Targets of a page: that of the first canonical link, of the first og:url, and of all anchors in order; attributes in any order and quoting, entities resolved."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.first, self.anchors = {}, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "link" and "canonical" in (a.get("rel") or "").split():
            self.first.setdefault("canonical", a.get("href"))
        if tag == "meta" and a.get("property") == "og:url":
            self.first.setdefault("og:url", a.get("content"))
        if tag == "a" and a.get("href") is not None:
            self.anchors.append(a["href"])

    def targets(self) -> list[str]:
        return [x for x in (self.first.get("canonical"), self.first.get("og:url")) if x is not None] + self.anchors


def page_targets(page: str | None, base: str | None) -> list[str]:
    """Targets as absolute urls, by reference resolution against the page's own url; what can't be resolved is left out."""
    links = _Links()
    links.feed(page or "")
    links.close()
    out = []
    for target in links.targets():
        try:
            out.append(urljoin(base or "", target))
        except ValueError:
            continue
    return out


@F.pandas_udf(ArrayType(StringType()))
def absolute_targets(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([page_targets(h, b) for h, b in zip(html, base, strict=True)])


def publisher_links(pages: DataFrame, id_col: str, html: Column, base: Column) -> DataFrame:
    """C4: (id_col, publisher_url): canonical link, og:url, then anchors; the first safe one that isn't an aggregator's."""
    links = pages.select(id_col, F.posexplode(absolute_targets(html, base)).alias("pos", "link"))
    return links.where(safe_url(F.col("link")) & ~is_aggregator(F.col("link"))).groupBy(id_col).agg(F.min_by("link", "pos").alias("publisher_url"))


def enriched(articles: DataFrame, owned: DataFrame, identified: DataFrame, pages: DataFrame) -> DataFrame:
    """articles(seq, url), owned(seq), identified(seq), pages(url, evidence, tier, resolved_url, optionally fetch_status as of B22): no owner passes through, identified ones don't need text, others get
    their page's; success replaces the canonical url unless it is an aggregator's. A url that isn't safe is blocked unfetched. Pages with a seq in place of the url were landed for each article: then articles that share a url keep their own."""
    if "fetch_status" not in pages.columns:
        pages = pages.withColumn("fetch_status", F.lit("success"))
    key = "seq" if "seq" in pages.columns else "url"
    met = articles.join(owned.select("seq", F.lit(True).alias("_o")), "seq", "left").join(identified.select("seq", F.lit(True).alias("_i")), "seq", "left").join(pages.dropDuplicates([key]), key, "left")
    needs = F.col("_o").isNotNull() & F.col("_i").isNull()
    status = F.when(F.col("_o").isNull(), "no_owner").when(F.col("_i").isNotNull(), "not_needed").when(~safe_url(F.col("url")), "blocked").when(F.col("fetch_status") != "success", F.col("fetch_status")).when(F.col("evidence").isNull(), "insufficient_content").otherwise("success")
    resolved = F.coalesce("resolved_url", "url")
    return met.select("seq", "url", status.alias("status"), F.when(status == "success", F.col("evidence")).alias("text"), F.when(needs, F.col("tier")).alias("tier"), F.when((status == "success") & ~is_aggregator(resolved), canonical_url(resolved)).otherwise(canonical_url(F.col("url"))).alias("canonical_url"), F.when(status == "success", F.col("resolved_url")).alias("resolved_url"))


#: How a needed fetch may end.
FETCH_ENDS = ("success", "timeout", "http_error", "blocked", "parse_error", "insufficient_content")


def enrichment_counters(rows: DataFrame, seen_before: DataFrame, seen_after: DataFrame) -> DataFrame:
    """One row of counters over `enriched` rows: candidates, skipped (identity was visible), attempted (distinct urls of candidates that are safe), each end, resolved publisher urls, cache hits (candidates whose url another one fetched),
    and matches that the feed text of skipped articles, and the page text of enriched ones, gave: seen_before(seq, n), seen_after(seq, n)."""
    need = F.col("status").isin(*FETCH_ENDS)
    key = F.when(need, F.lower(F.trim(canonical_url(F.col("url")))))
    met = rows.join(seen_before.select("seq", F.col("n").alias("_before")), "seq", "left").join(seen_after.select("seq", F.col("n").alias("_after")), "seq", "left")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    return met.agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(need).alias("candidates"), F.count_if(F.col("status") == "not_needed").alias("skipped"), F.count_distinct(F.when(safe_url(F.col("url")), key)).alias("attempted"),
        *(F.count_if(F.col("status") == s).alias(s) for s in FETCH_ENDS), F.count_if((F.col("status") == "success") & F.col("resolved_url").isNotNull() & ~is_aggregator(F.col("resolved_url"))).alias("resolved_urls"),
        (F.count_if(need) - F.count_distinct(key)).alias("cache_hits"), total(F.col("status") == "not_needed", "_before").alias("matches_before"), total(F.col("status") == "success", "_after").alias("matches_after"),
    )
