from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import mining, names, urls
from pagelathe.functions import text as tx


def each(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in rows.select("i", make(F.col("s")).alias("o")).orderBy("i").collect()]


def test_white_space_and_lines(spark):
    assert each(spark, tx.trim, ["  a \n b ", None, ""]) == ["a b", None, ""]
    assert each(spark, tx.blanks, ["a\xa0b\t c", None]) == ["a\xa0b c", None]
    assert each(spark, tx.line, ["a&#13;b\x07", "&nbsp; ", None]) == ["a b", None, None]
    assert each(spark, lambda s: tx.cap(s, 5), ["abcdef", "abcde"]) == ["abcd…", "abcde"]


def test_entities(spark):
    assert each(spark, tx.unescape, ["&lt;a&gt; &amp;lt; &copy;", None]) == ["<a> &lt; ©", None]
    assert each(spark, tx.unescape_all, ["&eacute;&#233;&#xE9;", None]) == ["ééé", None]


def test_encoding_repair(spark):
    assert each(spark, tx.repair_encoding, ["cafÃ©", "café", r"é", None]) == ["café", "café", "é", None]


def test_tags(spark):
    assert each(spark, tx.split_tags, ["a, b|c", "a|b", "x、y", "one", "", None]) == [["a", "b|c"], ["a", "b"], ["x", "y"], ["one"], [], None]
    assert each(spark, tx.normalize_tags, ["\"a\", 'b', , c/d", None]) == ["a, b, c/d", None]


AUTHORS = [
    ("By Jane Doe and John Roe", "Jane Doe; John Roe"),
    ("written by jane doe; JOHN ROE", "Jane Doe; JOHN ROE"),
    ("Jane Doe @jane, Jane Doe Jr", "Jane Doe"),
    ("Jane Doe 12 May", "Jane Doe"),
    ("https://example.com/jane", None),
    ("jane@example.com", None),
    ("Jane Doe | Desk &amp; John Roe", "Jane Doe; Desk; John Roe"),
    ("Jane Doe for The Paper", "Jane Doe"),
    ("José Ángel 🎉", "José Ángel"),
    ("jane.doe", "Jane Doe"),
    ("", None),
]


def test_authors_in_both_forms(spark):
    got = each(spark, tx.normalize_authors, [a for a, _ in AUTHORS])
    assert got == [b for _, b in AUTHORS]
    assert ["; ".join(names.joined([], names.split_names(a))) or None for a, _ in AUTHORS] == got


def test_blocked_authors(spark):
    assert each(spark, lambda s: tx.check_authors(s, F.array(F.lit("udn"))), ["Jane; UDN", "udn", None]) == ["Jane", None, None]


def test_json_minify(spark):
    assert each(spark, tx.json_minify, ['{ "a b" : [1, 2],\n "c":"x \\" y" }']) == ['{"a b":[1,2],"c":"x \\" y"}']


def test_casts(spark):
    row = spark.createDataFrame([("é", ["é"], {"k": "é"})], "s string, a array<string>, m map<string,string>").select(
        tx.to_text(tx.to_bytes(F.col("s"))).alias("s"), tx.list_to_text(tx.list_to_bytes(F.col("a"))).alias("a"), tx.map_to_text(tx.map_to_bytes(F.col("m"))).alias("m")
    ).first()
    assert (row["s"], row["a"], row["m"]) == ("é", ["é"], {"k": "é"})


DATES = [
    ("https://a.example.com/news/2022/oct/27/slug/", (2022, 10, 27)),
    ("https://a.example.com/2017/10/18/slug/1/", (2017, 10, 18)),
    ("https://a.example.com/2017/01/23/politics/index.html", (2017, 1, 23)),
    ("https://a.example.com/2015/01/slug/", (2015, 1, 1)),
    ("https://a.example.com/2022/2/29/slug/index.html", (2022, 2, 28)),
    ("http://a.example.com/2015/Slug/id-1", (2015, 1, 1)),
    ("http://a.example.com/world/2022-10/08/content.htm", (2022, 10, 8)),
    ("https://a.example.com/en-gb/news/slug/ar-AA12", (2022, 1, 1)),
    ("http://a.example.com/~/718271584/0/slug-March/", (2022, 1, 1)),
]


@pytest.mark.parametrize(("url", "want"), DATES)
def test_dates_in_paths(spark, url, want):
    day = spark.range(1).select(urls.override_date(F.lit(datetime.datetime(2022, 1, 1, 12, 11, 10)), F.lit(url)).alias("d")).first()["d"]
    assert day == datetime.date(*want)


def test_urls(spark):
    told = ["HTTP://User@Www.Example.CO.UK:80//a///b?b=2&a=1&c=&d#top", "https://x.example.com:443", "https://a.example.com:8443/p?", "ftp://x.example.com/", "nothing", None, "https://www.a", "http://a.b"]
    assert each(spark, urls.normalize, told[:3]) == ["http://www.example.co.uk/a/b?a=1&b=2#top", "https://x.example.com", "https://a.example.com:8443/p"]
    assert each(spark, urls.domain, told[:3]) == ["example.co.uk", "example.com", "example.com"]
    assert each(spark, urls.is_valid, told) == [False, True, True, False, False, False, False, False]


def test_dates(spark):
    told = ["2021-03-04T05:06:07Z", "2021-03-04", "4 March 2021", "Mar 4, 2021", "Thu, 04 Mar 2021 05:06:07 GMT", "2021年3月4日", "no date", None]
    got = each(spark, urls.parse_date, told)
    assert [None if g is None else g.date() for g in got] == [datetime.date(2021, 3, 4)] * 6 + [None, None]


@pytest.mark.parametrize(
    ("host", "want"),
    [("www.a.co.uk", "a.co.uk"), ("a.b.com.au", "b.com.au"), ("x.or.jp", "x.or.jp"), ("www.example.com", "example.com"), ("deep.sub.example.org", "example.org"), ("co.uk", "co.uk"), ("a.uni.de", "uni.de"), ("a.net.com", "net.com")],
)
def test_registered_domains(spark, host, want):
    row = spark.createDataFrame([(f"https://{host}:8080/x",)], "u string").select(urls.domain(F.col("u"))).first()
    assert row[0] == want == mining.domain(f"https://{host}:8080/x")
