"""Typed facts of an article (actions, milestones, parties, amounts, percentages, dates, subjects) and comparisons of two articles' facts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import nfkc_casefold, query_key, title_key

#: Phrases of the action classes.
ACTIONS = {
    "funding": ("raise", "raises", "raised", "funding", "financing", "investment round", "투자 유치", "투자유치", "펀딩"),
    "investment": ("invests in", "investment in", "stake investment", "지분 투자"),
    "acquisition": ("acquire", "acquires", "acquired", "acquisition", "buyout", "buys", "merger", "인수", "합병"),
    "partnership": ("partnership", "partners with", "partnered with", "collaboration", "제휴", "협력", "파트너십"),
    "contract": ("agreement", "contract", "협약", "계약"),
    "ipo_filing": ("ipo filing", "files for ipo", "filed for ipo", "listing application", "상장 예비심사", "상장예비심사", "상장 신청"),
    "ipo_pricing": ("ipo pricing", "prices ipo", "priced ipo", "공모가 확정", "공모가격"),
    "commercial_launch": ("commercial launch", "launches", "launched", "product launch", "출시", "상용화"),
    "regulatory_approval": ("regulatory approval", "fda approval", "approval", "approved", "approves", "허가", "승인"),
    "regulatory_application": ("applies for", "seeks approval", "submits application", "신청", "허가 신청"),
    "termination": ("terminates", "terminated", "cancels", "cancelled", "ends partnership", "해지", "종료", "철회"),
    "trial_result": ("trial results", "trial result", "topline", "임상 결과", "시험 결과"),
    "clinical_trial": ("clinical trial", "phase 1", "phase 2", "phase 3", "임상", "시험"),
    "penalty": ("penalty", "fine", "sanction", "과징금", "벌금", "제재"),
}
#: Phrases of the milestone classes.
MILESTONES = {
    "filing": ("filing", "files for", "application", "예비심사", "신청"),
    "pricing": ("pricing", "prices", "priced", "공모가", "가격 확정"),
    "signed": ("signed", "signs", "체결"),
    "launch": ("launch", "launched", "launches", "출시", "상용화"),
    "approval": ("approval", "approved", "approves", "허가", "승인"),
    "trial_start": ("trial begins", "trial starts", "임상 개시", "시험 개시"),
    "trial_result": ("trial results", "trial result", "topline", "임상 결과", "시험 결과"),
    "closing": ("closing", "closed", "거래 종결", "인수 완료"),
}
#: Words that name no subject; subjects too general to tell events apart; words of aerospace reporting.
STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "into", "of", "on", "the", "to", "with", "announces", "announced", "company", "regulator", "update", "new", "대한", "관련", "발표")
GENERIC = ("co", "kr", "com", "net", "뉴스", "일", "발사", "시험", "시험비행", "추진", "첫", "새벽", "마쳐", "도전", "리허설", "발표", "관련", "소식", "업데이트")
AEROSPACE = ("로켓", "발사", "우주", "준궤도", "위성", "시험비행")
#: Patterns of parties, numbers, money and dates, and factors of the units. (?U): letters, digits and word ends as Unicode has them.
PARTY = r"(?:partnership with|partners with|partnered with|from|versus|vs\.?|acquisition of|merger with|contract with|agreement with|with)\s+([A-Z][A-Za-z0-9.'-]*(?:\s+(?:(?:and|&)\s+)?[A-Z][A-Za-z0-9.'-]*|\s*,\s*[A-Z][A-Za-z0-9.'-]*){0,8})"
PARTY_SPLIT = r"(?i)\s*(?:,|\band\b|&)\s*"
PARTY_LISTED = r"([가-힣A-Za-z0-9.&-]{2,30})(?=\s*(?:와|과|·|,))"
PARTY_LISTED_MARKS, PARTY_LAST_MARKS = ("와", "과", "·", ","), ("협력", "제휴", "계약", "협약", "파트너십")
PARTY_LAST = rf"([가-힣A-Za-z0-9.&-]{{2,30}})(?:와|과)?\s*(?=(?:{'|'.join(PARTY_LAST_MARKS)}))"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
UNITS_EN = {"k": 10**3, "thousand": 10**3, "m": 10**6, "mn": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "billion": 10**9, "trillion": 10**12}
UNITS_KO = {"천": 10**3, "만": 10**4, "백만": 10**6, "천만": 10**7, "억": 10**8, "조": 10**12}
_EN = r"(thousand|million|billion|trillion|k|m|mn|b|bn)?"
AMOUNTS = (  # currency, units, marks without one of which the pattern can't match, pattern
    ("KRW", UNITS_KO, ("원",), rf"(?iU)({NUMBER})\s*(천만|백만|천|만|억|조)?\s*원"),
    ("KRW", UNITS_EN, ("won",), rf"(?iU)({NUMBER})\s*{_EN}\s*won\b"),
    ("KRW", UNITS_EN, ("₩", "krw"), rf"(?iU)(?:₩|krw\s*)({NUMBER})\s*{_EN}"),
    ("USD", UNITS_EN, ("$", "usd"), rf"(?iU)(?:\$|usd\s*)({NUMBER})\s*{_EN}"),
    ("USD", UNITS_EN, ("dollar", "usd"), rf"(?iU)({NUMBER})\s*{_EN}\s*(?:dollars?|usd)\b"),
)
PERCENT = rf"(?iU)\b({NUMBER})\s*(?:%|percent|pct)(?!\w)"
ISO_DATE = r"(?U)\b(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})\b"
KO_DATE = r"(?U)\b(20\d{2})년\s*(\d{1,2})월\s*(\d{1,2})일\b"
KO_DAY = r"(?U)(?<!\d)([1-9]|[12]\d|3[01])일(?=\s|$|[,.…'\"])"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
EN_DATE = r"(?iU)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{1,2}),?\s+(20\d{2})\b"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def marked(text: Column, marks) -> Column:
    """Whether the text has one of the marks: a search of bytes, which tells without a pattern most texts that a pattern can't match."""
    needed = [m for m in marks if not any(o != m and o in m for o in marks)]
    return reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in needed))


def ordered_hits(folded: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """Names of the classes with a phrase in the text, by first place and then name. ASCII phrases need bare boundaries."""
    plain, wide = [], []
    for name, phrases in classes.items():
        ascii_ones = [p for p in phrases if re.fullmatch("[a-z0-9 ]+", p)]
        if ascii_ones:
            plain.append(F.struct(F.when(marked(folded, ascii_ones), F.regexp_instr(folded, F.lit(f"(?<![a-z0-9])(?:{'|'.join(ascii_ones)})(?![a-z0-9])"))).alias("at"), F.lit(name).alias("name")))
        wide += [F.struct(F.locate(p, folded).alias("at"), F.lit(name).alias("name")) for p in phrases if p not in ascii_ones]
    places = F.concat(F.array(*plain), F.when(F.octet_length(folded) > F.length(folded), F.array(*wide)).otherwise(F.array().cast("array<struct<at:int,name:string>>")))
    return F.array_distinct(F.transform(F.sort_array(F.filter(places, lambda s: s["at"] > 0)), lambda s: s["name"]))


def plain_decimal(d: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def amounts(text: Column, low: Column | None = None) -> Column:
    """H4e: CUR:plain-decimal. low: the text in lower case, where the caller has it as a column."""
    low = F.lower(text) if low is None else low
    none = F.array().cast("array<string>")
    parts = []
    for currency, units, marks, pattern in AMOUNTS:
        parts.append(F.when(marked(low, marks), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _money(pattern, _map({"": 1} | units), currency))).otherwise(none))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())))


def _money(pattern: str, factor: Column, currency: str):
    def told(match: Column) -> Column:
        number = F.replace(F.regexp_extract(match, pattern, 1), F.lit(","), F.lit("")).try_cast("decimal(20,6)")
        return F.concat(F.lit(f"{currency}:"), plain_decimal(number * F.element_at(factor, F.lower(F.regexp_extract(match, pattern, 2))).cast("decimal(13,0)")))

    return told


def _all(text: Column, pattern: str, group: int, possible: Column) -> Column:
    """All matches of the pattern, which isn't tried on a text where it is impossible."""
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).when(text.isNotNull(), F.array().cast("array<string>"))


def percentages(text: Column, low: Column | None = None) -> Column:
    """H4f: decimal fractions as text. low as in amounts."""
    found = _all(text, PERCENT, 1, marked(F.lower(text) if low is None else low, ("%", "percent", "pct")))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: plain_decimal((F.replace(n, F.lit(","), F.lit("")).cast("decimal(20,6)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(28,8)")))))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def _three(text: Column, pattern: str, order: tuple[int, int, int], possible: Column) -> Column:
    """Year, month and day of the matches: one pass over the text; a match by itself matches with the same groups, since all that the patterns ask of its surroundings is a word's end."""
    return F.transform(_all(text, pattern, 0, possible), lambda x: F.struct(*(F.regexp_extract(x, pattern, k).alias(c) for k, c in zip(order, "ymd", strict=True))))


def dates(text: Column, published: Column, low: Column | None = None) -> Column:
    """H4g: ISO-like, Korean and English dates; a bare Korean day is the nearest of three months, within 14 days of publication (the earlier month at a tie). low as in amounts."""
    month_no = _map({m: str(k) for k, m in enumerate(MONTHS, 1)})
    english = F.transform(_three(text, EN_DATE, (3, 1, 2), F.contains(text, F.lit("20")) & marked(F.lower(text) if low is None else low, MONTHS)), lambda x: _day(x["y"], F.element_at(month_no, F.lower(F.substring(x["m"], 1, 3))), x["d"]))
    full = F.flatten(F.array(*(F.transform(_three(text, p, (1, 2, 3), F.contains(text, F.lit(mark))), lambda x: _day(x["y"], x["m"], x["d"])) for p, mark in ((ISO_DATE, "20"), (KO_DATE, "년"))), english))
    day = F.to_date(published)
    months = F.array(*(F.date_format(F.add_months(F.trunc(day, "month"), k), "yyyy-MM") for k in (-1, 0, 1)))
    near = lambda n: F.array_min(F.filter(F.transform(months, lambda m, i: F.struct(F.abs(F.date_diff(F.try_to_date(F.concat_ws("-", m, F.lpad(n, 2, "0")), "yyyy-MM-dd"), day)).alias("gap"), i.alias("i"), F.try_to_date(F.concat_ws("-", m, F.lpad(n, 2, "0")), "yyyy-MM-dd").alias("date"))), lambda s: s["gap"].isNotNull()))
    bare = F.transform(F.filter(F.transform(_all(text, KO_DAY, 1, F.contains(text, F.lit("일"))), near), lambda s: s["gap"] <= 14), lambda s: s["date"])
    every = F.concat(full, F.coalesce(bare, F.array().cast("array<date>")))
    return F.sort_array(F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: x.cast("string"))))


def with_facts(df: DataFrame, title: str = "title", description: str = "description", text: str = "text", published: str = "published_at", families: Column | None = None) -> DataFrame:
    """df with `facts`, a struct of sorted arrays (H4), and `title_key`. Computed once for each article; drop the long columns before joining pairs."""
    whole = F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in (title, description, text)))
    out = df.withColumn("_whole", whole).withColumn("_low", F.lower("_whole")).withColumn("title_key", title_key(F.col(title))).withColumn("_title", query_key(F.col(title))).withColumn("_text", query_key(F.col("_whole")))
    out = out.withColumn("_actions", F.array_distinct(F.concat(ordered_hits(F.col("_title"), ACTIONS), ordered_hits(F.col("_text"), ACTIONS))))
    aerospace = F.exists(F.array(*map(F.lit, AEROSPACE)), lambda w: F.contains(F.col("_whole"), w))
    out = out.withColumn("_actions", F.filter("_actions", lambda a: ~((a == "clinical_trial") & aerospace)))  # H4b; one mention of _actions, so that it isn't computed twice
    out = out.withColumn("_milestones", F.sort_array(ordered_hits(F.col("_title"), MILESTONES)))
    segments = F.flatten(F.transform(F.regexp_extract_all(F.col(title), F.lit(PARTY), F.lit(1)), lambda s: F.split(s, PARTY_SPLIT)))
    named = F.concat(segments, *(_all(F.col(title), p, 1, marked(F.col(title), marks)) for p, marks in ((PARTY_LISTED, PARTY_LISTED_MARKS), (PARTY_LAST, PARTY_LAST_MARKS))))  # H4d
    out = out.withColumn("_parties", F.filter(F.split(F.regexp_replace(nfkc_casefold(F.array_join(named, "\u0001")), r"[ \t\n]+", " "), "\u0001"), lambda p: F.trim(p) != ""))
    tokens = F.regexp_extract_all(F.col("title_key"), F.lit("([a-z0-9]+|[가-힣]+)"), F.lit(1))  # H4h
    subjects = F.filter(F.array_except(F.array_except(F.array_except(tokens, F.array(*map(F.lit, STOPWORDS))), F.col("_actions")), F.col("_milestones")), lambda t: ~t.rlike("^[0-9]+$"))
    none = F.array().cast("array<string>")
    facts = F.struct(
        F.sort_array("_actions").alias("actions"), F.slice("_actions", 1, 1).alias("primary"), F.sort_array(F.slice("_actions", 2, 100)).alias("secondary"),
        F.sort_array(F.array_distinct(F.transform("_parties", lambda p: F.trim(p)))).alias("parties"), F.col("_milestones").alias("milestones"), dates(F.col("_whole"), F.col(published), F.col("_low")).alias("dates"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(F.col("_text"), F.lit(r"(?U)\b(\d+(?:\.\d+)?)\b"), F.lit(1)))).alias("numbers"),  # H4i
        amounts(F.col("_whole"), F.col("_low")).alias("amounts"), percentages(F.col("_whole"), F.col("_low")).alias("percentages"), F.sort_array(subjects).alias("subjects"),
        F.sort_array(F.array_distinct(F.filter(F.coalesce(families, none) if families is not None else none, lambda f: (f != "") & (f != "none")))).alias("families"),
    )
    return out.withColumn("facts", facts).drop("_whole", "_low", "_title", "_text", "_actions", "_milestones", "_parties")


def signature(facts: Column) -> Column:
    """H4j."""
    return F.array_distinct(F.concat(*(facts[k] for k in ("primary", "parties", "milestones", "dates", "amounts", "percentages", "subjects"))))


def _both(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0)


def conflict(a: Column, b: Column) -> Column:
    """The first category whose two sets are non-empty and disjoint."""
    names = {"amounts": "amount_conflict", "percentages": "percentage_conflict", "parties": "counterparty_conflict", "primary": "action_conflict", "milestones": "milestone_conflict", "dates": "explicit_date_conflict", "families": "event_family_conflict"}
    return F.coalesce(*(F.when(_both(a[k], b[k]) & ~F.arrays_overlap(a[k], b[k]), F.lit(v)) for k, v in names.items()))


def partial_mismatch(a: Column, b: Column) -> Column:
    """H5b."""
    return F.greatest(*(_both(a[k], b[k]) & (a[k] != b[k]) for k in ("amounts", "percentages", "parties", "primary", "milestones", "dates")))


def shared_identity(a: Column, b: Column) -> Column:
    """H5c."""
    names = {"amounts": "amount", "percentages": "percentage", "parties": "counterparty", "dates": "date"}
    return F.filter(F.array(*(F.when(_both(a[k], b[k]) & (a[k] == b[k]), F.lit(v)) for k, v in names.items())), lambda x: x.isNotNull())
