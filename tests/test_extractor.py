"""The whole dataflow, hooks, merging, evaluation, sources and streams."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import evaluate, merge
from pagelathe.operators.decode import names_of
from pagelathe.plans.extractor import Extractor, extract_news
from pagelathe.runtime import read_table
from pagelathe.sources import pages as src
from pagelathe.streaming import pages as st
from tests.oracle import SMALL

PAGE = """<html><head><title>Bridge reopens - The Daily</title><meta property="article:published_time" content="2021-03-04T05:06:07Z"></head><body>
<nav><a href='/'>Home</a></nav><h1>Bridge reopens</h1><p class='byline'>By Jane Doe</p>
<p>The old bridge over the river was opened again on Thursday after two years of careful repair work by the city.</p>
<p>Hundreds of people walked across it in the morning, and many of them said that they had missed the short way to the market.</p>
<div class='footer'><a href='/about'>About</a></div></body></html>"""


def pages(spark, html=(PAGE,)):
    return spark.createDataFrame([(i, f"https://www.daily.example.com/2020/05/06/{i}/", h) for i, h in enumerate(html)], src.PAGES)


def test_record(spark):
    r = extract_news(pages(spark)).first()
    assert r["title"] == "Bridge reopens"
    assert r["headline"] == "Bridge reopens"
    assert r["author"] == "Jane Doe"
    assert r["hostname"] == "example.com"
    assert r["sitename"] == "daily.example.com"
    assert r["content"].count("\n") == 1
    assert "Hundreds" in r["content"]
    assert "About" not in r["content"]
    assert r["date"] == datetime.date(2020, 5, 6)  # the address overrides
    assert r["rawDate"].startswith("2021-03-04")
    assert r["_error"] is None


def test_hooks_keep_the_precedence(spark):
    ex = Extractor(
        meta_postprocess=[{"license": lambda h: F.lit("first"), "title": lambda h: F.lit("never")}, {"license": lambda h: F.lit("second")}],
        postprocess=[lambda df: df.withColumn("n_chars", F.length("content")).withColumn("title", F.lit("changed"))],
    )
    r = ex(pages(spark)).first()
    assert r["license"] == "first"
    assert r["title"] == "Bridge reopens"
    assert r["n_chars"] == len(r["content"])


def test_rows_are_kept_whatever_they_hold(spark):
    html = [None, "", "<p>x</p>", PAGE, "<" * 3000, "\x00"]
    rows = extract_news(pages(spark, html))
    assert rows.count() == len(html)
    assert rows.where("_error IS NOT NULL").count() == 0
    assert extract_news(pages(spark, [])).collect() == []


def test_no_shuffle(spark):
    plan = Extractor()(read_table(spark, SMALL, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_merging(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "10", "c": None}, ["x"], None)], "x map<string,string>, m map<string,string>, l array<string>, n array<string>").select(
        merge.merge_maps(F.col("x"), F.col("m")).alias("m"), merge.append(F.col("l"), F.col("n")).alias("l"), merge.complete(F.col("l"), F.col("n")).alias("c"), merge.prefer(F.col("n"), F.col("l")).alias("p")
    ).first()
    assert row["m"] == {"a": "1", "b": "10"}
    assert row["l"] == row["p"] == ["x"]
    assert row["c"] is False


def test_last_readable_date_counts(spark):
    found = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("score")) for t, s in (("2020-01-02", 0.5), ("2021-03-04", 0.3), ("no date", 0.2))])
    assert spark.range(1).select(merge.last_date(found).alias("d")).first()["d"]["text"] == "2021-03-04"


@pytest.mark.parametrize(
    ("told", "want"),
    [
        ("By BASSEM MROUE, SARAH EL DEEB and ZEINA KARAM", ["BASSEM MROUE", "SARAH EL DEEB", "ZEINA KARAM"]),
        ("Bassem Mroue, Sarah El Deeb And Zeina Karam", ["Bassem Mroue", "Sarah El Deeb", "Zeina Karam"]),
        ("Mohammad Arief Hidayat,Ahmad Farhan Faris", ["Mohammad Arief Hidayat", "Ahmad Farhan Faris"]),
        ("撰文／莊正賢", ["莊正賢"]),
        ("von Jane Doe", ["Jane Doe"]),
        ("", []),
    ],
)
def test_names_by_rules(spark, told, want):
    assert spark.range(1).select(names_of(F.lit(told)).alias("n")).first()["n"] == want


def test_precision_recall(spark):
    p, a = "skiing sparkling soft snow in soft sun".split(), "soft snow in soft sun soft turns turns".split()
    df = spark.createDataFrame([(1, p, a), (2, [], a), (3, [], [])], "k int, p array<string>, a array<string>")
    sets = {r["k"]: tuple(r["m"]) for r in df.select("k", evaluate.prf_sets(F.col("p"), F.col("a")).alias("m")).collect()}
    assert sets[1] == pytest.approx((4 / 6, 4 / 5, 2 * (4 / 6) * (4 / 5) / (4 / 6 + 4 / 5)))
    assert sets[2] == sets[3] == (0.0, 0.0, 0.0)
    many = {r["k"]: (r["precision"], r["recall"]) for r in evaluate.prf_multisets(df, "k", "p", "a").collect()}
    assert many[1] == pytest.approx((5 / 7, 5 / 8))


def test_subsequences_and_distances(spark):
    x, y = ["some", "words", "here", "the", "football"], ["he", "said", "words", "kick", "the", "football"]
    df = spark.createDataFrame([(x, y, "kitten", "sitting"), (None, y, "ab", "ba"), ([], [], "", "abc")], "x array<string>, y array<string>, a string, b string")
    rows = df.select(evaluate.lcs_inclusion("x", "y").alias("i"), evaluate.lcs_diff("x", "y").alias("d"), evaluate.damerau_levenshtein("a", "b").alias("e")).collect()
    assert rows[0]["i"] == [False, True, False, True, True]
    assert [t[2:] for t in rows[0]["d"] if t[0] != "+"] == x
    assert [t[2:] for t in rows[0]["d"] if t[0] != "-"] == y
    assert rows[1]["i"] is None
    assert [r["e"] for r in rows] == [3, 1, 3]


def test_encodings(spark):
    told = [b'<?xml version="1.0" encoding="ISO-8859-1"?><html>\xe9', b'<meta http-equiv="content-type" content="text/html; charset=GB2312">', b"<html>sadfsa</html>", "é".encode(), b"\xe9", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, b binary")
    got = rows.select("i", src.guess_encoding(F.col("b"), "ascii").alias("g"), src.to_html(F.col("b")).alias("t"), src.encoding_candidates(F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["g"] for r in got][:3] == ["ISO-8859-1", "GB2312", "ascii"]
    assert got[0]["t"].endswith("é")
    assert [r["t"] for r in got][3:] == ["é", "é", None]
    assert [r["c"] for r in got][2:5] == [["utf-8"], ["utf-8"], ["iso-8859-1"]]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_bytes(PAGE.encode())
    rows = src.from_files(spark, str(tmp_path / "in"))
    assert rows.select("html").first()["html"] == PAGE
    assert src.from_list(spark, ["<p>x</p>", None]).count() == 2
    made = extract_news(src.from_parquet(spark, f"{SMALL}/pages.parquet"))
    for kind in ("parquet", "json"):
        src.write_records(made, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == made.count()


def test_pages_and_json_objects(spark):
    html = ['<script type="application/ld+json">{"@graph":[{"a":1},{"b":2}]}</script>', '<script type="application/ld+json">[{"c":3}]</script><script type="application/ld+json">{bad</script>', None]
    got = sorted((r["page_id"], r["object"]) for r in src.ld_json_objects(pages(spark, html)).collect())
    assert got == [(0, '{"a":1}'), (0, '{"b":2}'), (1, '{"c":3}')]
    assert [r["p"] for r in pages(spark, ["<html>x", "x", "<p><b>", None]).select(src.is_page(F.col("html")).alias("p")).collect()] == [True, False, True, False]


def test_streams_give_the_batch_result(spark, tmp_path):
    table = read_table(spark, SMALL, "pages").select("page_id", "url", "html")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    st.write(st.read_pages(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), extract_news).awaitTermination(120)
    a, b = spark.read.parquet(str(tmp_path / "out")).select("page_id", "title", "content"), extract_news(table).select("page_id", "title", "content")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_streams_drop_seen_addresses_and_count_hosts(spark, tmp_path):
    rows = [(1, "HTTPS://a.example.com//x", "2021-01-01 00:00:00"), (2, "https://a.example.com/x", "2021-01-01 00:01:00"), (3, "https://b.example.com/", "2021-01-01 00:20:00")]
    spark.createDataFrame(rows, "page_id long, url string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("page_id long, url string, ts timestamp").parquet(str(tmp_path / "in"))
    st.write(st.fresh(stream()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} in ({1, 3}, {2, 3})
    counts = st.host_counts(stream()).writeStream.format("memory").queryName("hosts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert {(r["host"], r["pages"]) for r in spark.table("hosts").collect()} == {("a.example.com", 2), ("b.example.com", 1)}
