from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as t


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.com/x?utm_source=f&b=2&a=1#top", "https://a.com/x?b=2&a=1"),
        ("https://A.com/X", "https://A.com/X"),
        ("https://a.com/?a", "https://a.com/?a="),
        ("https://a.com/?UTM_Medium=1&FBCLID=2", "https://a.com/"),
        ("https://a.com/?q=a%20b", "https://a.com/?q=a+b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, t.canonical_url, url) == want


def test_folding(spark):
    assert one(spark, t.title_key, "Ｆoo—ß_bar!!  2") == "foo ss_bar 2"
    assert one(spark, t.query_key, "  Ａ  b\tC ") == "a b c"
    assert one(spark, t.identity_key, "에이 비 (주)") == "에이비"
    assert one(spark, t.display_name, "(주) Foo Co, Pte. Ltd.") == "Foo Co"
    assert one(spark, t.display_name, "Foo Inc., Ltd.") == "Foo"


def test_source_name(spark):
    got = one(spark, t.source_name, "새이름(구. 옛이름)")
    assert (got.current, got.former, got.malformed) == ("새이름", "옛이름", False)
    assert one(spark, t.source_name, "(구. 옛이름)").malformed


@pytest.mark.parametrize(
    ("told", "want"),
    [("Thu, 01 Jan 2026 09:00:00 +0900", datetime(2026, 1, 1)), ("01 Jan 2026 00:00:00 GMT", datetime(2026, 1, 1)), ("01 Jan 2026 00:00:00", datetime(2026, 1, 1)), ("nonsense", None), ("Wed, 31 Dec 2025 19:00:00 EST", datetime(2026, 1, 1)), ("31 Dec 25 16:00 PST", datetime(2026, 1, 1)), ("1 Jan 70 00:00:00 GMT", datetime(1970, 1, 1)), ("01 Jan 2026 00:00:00 XYZ", datetime(2026, 1, 1)), ("Thu, 32 Jan 2026 00:00:00 GMT", None)],
)
def test_published_at(spark, told, want):
    assert one(spark, lambda c: t.published_at(c).cast("timestamp_ntz"), told) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.com/x", True), ("http://10.0.0.1/", False), ("http://[::1]/", False), ("http://localhost/", False), ("http://x.local/", False), ("ftp://a.com/", False), ("https://u:p@a.com/", False), ("http://8.8.8.8/", True), ("https://a_b.example.com/x y", True), ("https://@a.com/", True), ("HTTPS://a.com", True), ("https:///x", False), ("http://[::1]:80/", False)],
)
def test_safe_url(spark, url, want):
    assert one(spark, t.safe_url, url) is want


def test_plain_text(spark):
    assert one(spark, t.plain_text, "<b>a</b> &lt;i&gt;b&amp;c") == "a b&c"
    assert one(spark, t.plain_text, "<br> ") is None
    assert one(spark, t.plain_text, "a&nbsp;&nbsp;b\u3000c\u2003") == "a b c"
    assert one(spark, t.query_key, "\u00a0A\u3000B ") == "a b"


def test_hosts(spark):
    assert one(spark, t.url_host, "https://u:p@Under_score.example.com:8080/a b?x#y") == "under_score.example.com"
    assert one(spark, t.url_host, "no url") is None
    assert one(spark, lambda u: t.source_class(u, u), "https://my_desk.example.com/a b") == "direct_publisher"
    assert one(spark, t.wrapper_target, "https://news.google.com/rss/articles/x y?hl=de&oc=5").startswith("https://news.google.com/articles/x y?oc=5&hl=en-US")


def test_relative_age(spark):
    age = lambda a, b: one(spark, lambda x, y: t.relative_age(x.cast("timestamp"), y.cast("timestamp")), a, b)
    assert age("2026-01-01 00:00:30", "2026-01-01 00:00:00") == "now"
    assert age("2026-01-01 00:00:00", "2026-01-01 03:10:00") == "3h ago"
    assert age("2026-01-01 00:00:00", "2026-01-03 03:10:00") == "2d ago"
