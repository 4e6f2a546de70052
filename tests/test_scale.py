"""Work on large tables: rows dealt over tasks, markup read in one pass, nothing computed that nobody reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import tree, urls
from pagelathe.operators import blocks as bl
from pagelathe.operators import decode, dom, features, merge
from pagelathe.plans import extractor, mined, queries
from pagelathe.runtime import read_table

SMALL = "/root/testdata/sf0.001"


def shape(n: tree.Node) -> tuple:
    return n.tag, dict(n.attrs), n.text, n.tail, [shape(c) for c in n.children]


def by_library(html: str) -> tree.Node:
    builder = tree._Builder()
    builder.feed(html)
    builder.close()
    return builder.tree.root


def test_pages_made_of_a_table_of_one_file_are_dealt_over_tasks(spark):
    table = read_table(spark, SMALL, "orders")
    assert table.rdd.getNumPartitions() == 1
    made = mined.page(table, "o_orderkey", "<title>x</title>")
    sizes = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 1
    assert sum(sizes) == table.count()
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("html", [
    "<p>a &amp; b</p>", "<P CLASS=x class='y' hidden>a<br/>b</P><p/>c", "<script>if (a</p>b) '&amp;'</script>x", "<title>a</title><h1>b", "<!-- a --><!doctype html><p>x<p>y", "<a href=x/>y</a>", "a < b", "<p", "<title>a<b>c</b></title>", "<script>a", "",
])
def test_plain_markup_gives_the_tree_of_the_library(html):
    assert shape(tree.parse(html)) == shape(by_library(html))


def test_mixed_up_markup_gives_the_tree_of_the_library():
    bits = "<p> </p> <P&class=x> <a&href='x'> </a> <br/> <!-- --> <script> </script> <title> </title> < > / \" ' = &copy; a é <li> <td> <head> <body>".replace("&c", "\0c").split()
    pick = random.Random(5)
    for _ in range(3000):
        html = "".join(pick.choice(bits).replace("&", " ").replace("\0", "&") for _ in range(pick.randint(1, 12)))
        assert shape(tree.parse(html)) == shape(by_library(html)), html


def test_dates_are_tried_on_texts_of_their_shape_only(spark):
    told = [
        "2021-03-04T10:20:30Z", "2021-03-04T10:20:30.123+02:00", "2021-03-04T10:20:30", "2021-03-04 10:20:30", "2021-03-04 10:20", "2021-03-04", "2021/03/04 10:20", "2021/03/04", "2021.03.04", "Thu, 4 Mar 2021 10:20:30 +0100",
        "4 Mar 2021 10:20:30 GMT", "4 Mar 2021", "4 March 2021", "4 May 2021", "4 June 2021", "Mar 4, 2021", "March 4, 2021", "2021年3月4日", "soon", "2021-13-04", "4 Mars 2021", None,
    ]
    rows = spark.createDataFrame([(t,) for t in told], "s string").select("s", urls.parse_date(F.col("s")).alias("d")).collect()
    assert [r["s"] for r in rows if r["d"] is None] == ["soon", "2021-13-04", "4 Mars 2021", None]
    assert {(r["d"].year, r["d"].day) for r in rows if r["d"]} == {(2021, 4)}


def test_wanted_fields_of_blocks_are_those_of_all(spark):
    pages = read_table(spark, SMALL, "pages")
    some = ("pos", "text", "since_last")
    assert bl.with_blocks(pages, only=some).schema["blocks"].dataType.elementType.names == list(some)
    got, want = (bl.explode_blocks(bl.with_blocks(pages, only=o)).select("page_id", *some).collect() for o in (some, None))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        bl.with_blocks(pages, only=("no",))


def test_a_page_with_the_mark_of_cuts_in_it_is_cut_as_any_other(spark):
    rows = bl.explode_blocks(bl.with_blocks(spark.createDataFrame([(1, f"a<p>b{bl._MARK}c</p><p>d</p>")], "page_id long, html string")))
    assert [r["text"] for r in rows.orderBy("pos").collect()] == ["a", f"b{bl._MARK}c", "d"]


def test_scores_are_left_out_only_where_mining_found_all_that_is_wanted(spark):
    told = '<title>Told - Site</title><meta name="author" content="Jane Doe"><meta name="date" content="%s">'
    body = "<h1>A</h1><h1>B</h1><p class='author'>By John Roe</p><time>2001-02-03</time><p>" + "many words of a long paragraph " * 4 + ".</p>"
    heads = (told % "2021-03-04", told % "soon", "<title>Told - Site</title>", "")
    pages = spark.createDataFrame([(i, "http://www.example.com/x", f"<html><head>{h}</head><body>{body}</body></html>") for i, h in enumerate(heads)] + [(9, None, "no page"), (10, None, None)], "page_id long, url string, html string")
    whole = extractor.Extractor()(pages)
    for fields in (("date", "title", "author"), ("author",), ("title", "url"), ("rawDate", "tags"), ("content", "title"), ("authorConfidence",)):
        got = extractor.Extractor(fields=fields)(pages)
        assert got.columns == ["page_id", *fields, "_error"]
        assert sorted(got.collect()) == sorted(whole.select(got.columns).collect())
    needed = dict(extractor.Extractor().metadata(pages).select("page_id", merge.needs_scores(F.struct("title", "author", "rawDate"), ("date", "title", "author"))).collect())
    assert needed == {0: False, 1: True, 2: False, 3: False, 9: True, 10: True}


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_readability_of_pages_needs_no_shuffle_and_is_that_of_rows(spark):
    query = queries.readability_score(spark, SMALL)
    assert shuffles(query) == 0
    rows = dom.blockify(read_table(spark, SMALL, "pages")).withColumn("link_density", bl.link_density(F.col("text")))
    want = features.readability(rows).select("page_id", F.col("pos").cast("long").alias("pos"), F.round("readability", 6).alias("readability"))
    assert sorted(query.collect()) == sorted(want.collect())


def test_the_longest_blocks_are_ranked_in_the_row(spark):
    query = queries.topk_blocks(spark, SMALL)
    assert shuffles(query) == 0
    got = spark.createDataFrame([(1, [3, 9, 9, 1]), (2, [5]), (3, [])], "k long, s array<long>").select("k", decode.topk(F.col("s"), 3).alias("t")).collect()
    assert {r["k"]: [tuple(t) for t in r["t"]] for r in got} == {1: [(1, 9), (2, 9), (0, 3)], 2: [(0, 5)], 3: []}


def test_both_modes_of_links_are_told_in_one_pass(spark):
    """Rows are dealt once; nothing is joined."""
    assert "Join" not in (query := mined.link_modes(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert shuffles(query) == 1


def test_workers_send_the_wanted_fields_of_blocks_alone(spark):
    pages = read_table(spark, SMALL, "pages").limit(20)
    whole, some = (dom.parse_pages(pages, with_meta=False, fields=f) for f in (None, ("pos", "text")))
    assert some.schema["dom_blocks"].dataType.elementType.names == ["pos", "text"]
    cut = whole.select("page_id", F.transform("dom_blocks", lambda b: F.struct(b["pos"].alias("pos"), b["text"].alias("text"))).alias("dom_blocks"))
    assert sorted(some.select(*cut.columns).collect()) == sorted(cut.collect())
