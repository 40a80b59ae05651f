"""Dictionary entity matching with disambiguation, and owner resolution.

A dictionary within MOST_TERMS and MOST_CHARS (both counted) becomes an automaton that finds the spans of all terms, context terms included, in one pass over a text; boundaries, contexts and negative spans are read off them. It is sent to
the workers once, each builds it once, and articles are mapped without a shuffle. A larger dictionary is joined with the texts instead: candidates come from an equi-join on necessary keys (a term with an ASCII letter or digit is keyed by its first
run of [a-z0-9], which the boundary rule makes a whole run of the text, any other term by the first two characters of its blank-free form, text by all such keys), and exact predicates run on candidate rows. Both ways give the same rows (tested)."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from eventloom.functions.text import match_fold, query_key

#: Bounds of a dictionary that is sent to every worker.
MOST_TERMS, MOST_CHARS = 200_000, 16_000_000


def squashed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def bounded(term: Column) -> Column:
    """Pattern of F4: bare boundaries for terms with an ASCII letter or digit."""
    quoted = F.regexp_replace(term, r"([^\p{L}\p{N} ])", r"\\$1")
    return F.when(term.rlike("[a-z0-9]"), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))).otherwise(quoted)


def contains_term(folded: Column, term: Column) -> Column:
    """term in folded text; terms without ASCII letters and digits match with blanks removed, too. Both folded."""
    ascii_ = term.rlike("[a-z0-9]")
    return (F.trim(term) != "") & (~ascii_ | F.contains(folded, F.trim(term))) & (F.regexp(folded, bounded(F.trim(term))) | (~ascii_ & F.contains(squashed(folded), squashed(term))))


def any_term(folded: Column, terms: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda t: contains_term(folded, t)), F.lit(False))


@F.pandas_udf(BooleanType())
def outside_spans(text: pd.Series, pattern: pd.Series, negatives: pd.Series) -> pd.Series:
    """some span of the term lies outside every span of the negative patterns; no span passes."""

    def test(t: str, p: str, ns) -> bool:
        spans = [m.span() for m in re.finditer(p, t)]
        if not spans or ns is None or not len(ns):
            return True
        bad = [m.span() for n in ns for m in re.finditer(n, t)]
        return any(not any(s >= a and e <= b for a, b in bad) for s, e in spans)

    return pd.Series([test(*x) for x in zip(text, pattern, negatives, strict=True)])


def term_keys(terms: DataFrame) -> DataFrame:
    """terms(company_id, term, ...) with `term_fold` and `key`; one row for each company and folded form, that of the smallest rule."""
    rules = [c for c in terms.columns if c != "company_id"]
    folded = terms.withColumn("term_fold", F.trim(match_fold(F.col("term")))).where("term_fold <> ''")
    one = folded.groupBy("company_id", "term_fold").agg(F.min(F.struct(*rules)).alias("_one")).select("company_id", "term_fold", "_one.*")
    run = F.regexp_extract("term_fold", "[a-z0-9]+", 0)
    return one.withColumn("key", F.when(run != "", run).otherwise(F.substring(squashed(F.col("term_fold")), 1, 2)))


def text_keys(folded: Column, single: bool = False) -> Column:
    bare = squashed(folded)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))
    other = F.when(folded.rlike(r"[^\x00-\x7F]"), F.concat(grams, F.split(bare, "")) if single else grams).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1)), other))


def candidates(articles: DataFrame, terms: DataFrame, id_col: str, text: Column, broadcast_terms: int = 20_000) -> DataFrame:
    """(id_col, folded, company_id, term, term_fold, rule columns) of pairs that share a key."""
    folded = articles.select(F.col(id_col), match_fold(text).alias("folded"))
    keyed = term_keys(terms)
    small = keyed.limit(broadcast_terms + 1).count() <= broadcast_terms
    keys = folded.select(id_col, "folded", F.explode(text_keys(F.col("folded"), single=True)).alias("key"))
    if small:  # the text goes through the explode to the broadcast join within one task: it is folded once and never shuffled
        return keys.join(F.broadcast(keyed), "key").drop("key")
    return keys.drop("folded").join(keyed, "key").drop("key").join(folded, id_col)


def joined_matches(articles: DataFrame, terms: DataFrame, id_col: str, text: Column) -> DataFrame:
    """`matches` by a join with the dictionary, whatever its size."""
    c = candidates(articles, terms, id_col, text)
    folded, term = F.col("folded"), F.col("term_fold")
    none = F.array().cast("array<string>")
    col = lambda n: F.coalesce(F.col(n), none)
    hit = c.where(contains_term(folded, term))
    hit = hit.where((F.size(col("required")) == 0) | any_term(folded, col("required")))  # F7
    forbidden = F.coalesce(F.col("forbidden"), F.lit(False))
    hit = hit.where(~forbidden | (~any_term(folded, col("negative")) & any_term(folded, col("forbidden_required"))))  # F8
    english = term.rlike("[a-z]")
    hit = hit.where(~english | (~any_term(folded, col("english_negative")) & ((F.size(col("english_required")) == 0) | any_term(folded, col("english_required")))))  # F9
    text = F.when(F.size(col("negative")) > 0, folded).otherwise(F.lit(""))  # F6 tests spans in Python; texts go there only for terms with negative ones
    both = hit.where(outside_spans(text, bounded(term), F.transform(col("negative"), lambda n: bounded(F.trim(n))))).select(id_col, "company_id", "term", "term_fold")
    gathered = both.groupBy(id_col, "company_id").agg(F.array_sort(F.collect_set(F.struct("term_fold", "term"))).alias("found"))
    longest = F.filter("found", lambda x: ~F.exists(F.col("found"), lambda y: (x["term_fold"] != y["term_fold"]) & F.contains(y["term_fold"], x["term_fold"])))  # F10
    return gathered.select(id_col, "company_id", F.array_sort(F.transform(longest, lambda x: x["term"])).alias("matched_terms"))


class Matcher:
    """F4 to F10 for one text after another. rules: (company_id, term, term_fold, negative, required, forbidden, forbidden_required, english_negative, english_required)."""

    def __init__(self, rules: list[tuple]) -> None:
        from ahocorasick import Automaton

        self.words: dict[str, int] = {}
        number = lambda t: self.words.setdefault(t.strip(" "), len(self.words))
        several = lambda ts: tuple(number(t) for t in ts or () if t is not None and t.strip(" "))
        self.rules = [(company, term, fold, number(fold), *map(several, (negative, required)), bool(forbidden), *map(several, (forb_req, eng_neg, eng_req)), bool(required), bool(eng_req)) for company, term, fold, negative, required, forbidden, forb_req, eng_neg, eng_req in rules]
        self.by_word = defaultdict(list)
        for k, rule in enumerate(self.rules):
            self.by_word[rule[3]].append(k)
        self.exact, self.loose = Automaton(), Automaton()
        bare = defaultdict(list)
        for word, k in self.words.items():
            plain = re.search("[a-z0-9]", word) is None
            self.exact.add_word(word, (k, len(word), not plain))
            if plain and (b := re.sub(r"\s+", "", word)):
                bare[b].append(k)
        for word, ks in bare.items():
            self.loose.add_word(word, ks)
        for automaton in (self.exact, self.loose):
            automaton.make_automaton()

    def spans(self, folded: str) -> tuple[dict[int, list[tuple[int, int]]], set[int]]:
        """(spans of each term within its boundaries, terms that are there: by a span, or with blanks removed)."""
        found = defaultdict(list)
        if len(self.exact):
            for end, (k, n, edged) in self.exact.iter(folded):
                begin, end = end - n + 1, end + 1
                if edged and (folded[begin - 1 : begin] in _WORD or folded[end : end + 1] in _WORD):
                    continue
                found[k].append((begin, end))
        there = set(found)
        if len(self.loose):
            for _, ks in self.loose.iter(re.sub(r"\s+", "", folded)):
                there.update(ks)
        return found, there

    def found(self, text: str) -> dict[str, list[str]]:
        """company_id -> matched terms, sorted."""
        folded = unicodedata.normalize("NFKC", text).casefold().translate(_DASHES)
        spans, there = self.spans(folded)
        hits = defaultdict(dict)
        for k in (k for w in there for k in self.by_word.get(w, ())):
            company, term, fold, word, negative, required, forbidden, forb_req, eng_neg, eng_req, asks, eng_asks = self.rules[k]
            said = lambda ws: any(w in there for w in ws)
            if asks and not said(required):
                continue
            if forbidden and (said(negative) or not said(forb_req)):
                continue
            if re.search("[a-z]", fold) and (said(eng_neg) or (eng_asks and not said(eng_req))):
                continue
            own = _apart(spans.get(word, ()))
            bad = [s for w in negative for s in _apart(spans.get(w, ()))]
            if own and negative and all(any(b <= s and e <= t for b, t in bad) for s, e in own):
                continue
            hits[company][fold] = term
        return {c: sorted(t for f, t in terms.items() if not any(f != g and f in g for g in terms)) for c, terms in hits.items()}


_WORD, _DASHES = frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), str.maketrans("–—", "--")
_matchers: dict[str, Matcher] = {}  # the last one of a worker


def _apart(spans) -> list[tuple[int, int]]:
    """Spans from left to right that don't overlap."""
    out, last = [], -1
    for s, e in sorted(spans):
        if s >= last:
            out.append((s, e))
            last = e
    return out


RULE = ("term", "term_fold", "negative", "required", "forbidden", "forbidden_required", "english_negative", "english_required")


def scanned_matches(articles: DataFrame, rules: list[tuple], id_col: str, text: Column, company: str) -> DataFrame:
    """`matches` by an automaton over rules, which are broadcast. company: type of the company ids."""
    sent, token = articles.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex
    slim = articles.select(F.col(id_col).alias("id"), text.alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _matchers:
            _matchers.clear()
            _matchers[token] = Matcher(sent.value)
        matcher = _matchers[token]
        for batch in batches:
            got = [(i, c, terms) for i, t in zip(batch["id"], batch["text"], strict=True) if t for c, terms in matcher.found(t).items()]
            yield pd.DataFrame(got, columns=["id", "company_id", "matched_terms"])

    return slim.mapInPandas(scan, f"id {slim.schema['id'].dataType.simpleString()}, company_id {company}, matched_terms array<string>").withColumnRenamed("id", id_col)


def matches(articles: DataFrame, terms: DataFrame, id_col: str = "seq", text: Column | None = None, most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id_col, company_id, matched_terms). terms(company_id, term, negative, required, forbidden boolean, forbidden_required, english_negative, english_required: arrays of folded terms); ids of articles are unique."""
    text = text if text is not None else F.concat_ws("\n", "title", "description", "text")
    rules = term_keys(terms).select("company_id", *RULE)
    lists = [c for c in RULE if c not in ("term", "term_fold", "forbidden")]
    size = F.length("term_fold") + sum((F.coalesce(F.length(F.array_join(c, "")), F.lit(0)) for c in lists), F.lit(0))
    n, chars = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= most_terms and chars <= most_chars:
        return scanned_matches(articles, [tuple(r) for r in rules.collect()], id_col, text, terms.schema["company_id"].dataType.simpleString())
    return joined_matches(articles, terms, id_col, text)


def owners(articles: DataFrame, query_owners: DataFrame, known: DataFrame, id_col: str = "seq") -> DataFrame:
    """(id_col, company_ids): explicit ids that the registry knows first, then owners of `query`, then of `origin_queries`; distinct in order."""
    explicit = articles.select(id_col, F.posexplode("explicit_ids").alias("pos", "company_id")).join(known.select("company_id"), "company_id", "left_semi").select(id_col, F.lit(0).alias("rank"), "pos", F.array("company_id").alias("ids"))
    asked = articles.select(id_col, F.posexplode(F.concat(F.array("query"), F.coalesce("origin_queries", F.array().cast("array<string>")))).alias("pos", "q")).where("q IS NOT NULL")
    asked = asked.withColumn("query_key", query_key(F.col("q"))).join(query_owners.select("query_key", "company_ids"), "query_key").select(id_col, F.lit(1).alias("rank"), "pos", F.col("company_ids").alias("ids"))
    gathered = explicit.union(asked).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "ids"))).alias("all"))
    return gathered.select(id_col, F.array_distinct(F.flatten(F.transform("all", lambda s: s["ids"]))).alias("company_ids"))


def scoped_matches(articles: DataFrame, terms: DataFrame, owned: DataFrame, id_col: str = "seq", text: Column | None = None) -> DataFrame:
    """matches limited to the companies that own the article's queries; ownership alone accepts nothing."""
    scope = owned.select(id_col, F.explode("company_ids").alias("company_id"))
    return matches(articles, terms, id_col, text).join(scope, [id_col, "company_id"], "left_semi")


def first_rules(aliases: DataFrame) -> DataFrame:
    """aliases(identity, rule, pos) -> the first owner of each identity."""
    return aliases.groupBy("identity").agg(F.min_by("rule", "pos").alias("rule"))
