from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import blocks as bl
from pagelathe.operators import decode, dom, tagging
from pagelathe.operators import features as ft
from pagelathe.runtime import read_table
from tests.oracle import SMALL


def test_smoothing_literals(spark):
    x = [i * 10 / 9 for i in range(10)]
    want_x = [0.47448994, 1.18661763, 2.22759261, 3.33348203, 4.44444444, 5.55555556, 6.66651797, 7.77240739, 8.81338237, 9.52551006]
    want_d = [2.22222222, 2.22222222, 2.22222222, 2.22214787, 2.21961138, 2.18707981, 2.02019401, 1.63420945, 1.14625352, 0.79272618]
    row = spark.createDataFrame([(x,)], "x array<double>").select(ft.smooth(F.col("x")).alias("s"), ft.smooth(ft.forward_difference(F.col("x"))).alias("d")).first()
    assert row["s"] == pytest.approx(want_x, abs=1e-7)
    assert row["d"] == pytest.approx(want_d, abs=1e-7)


def test_readability_in_the_row_equals_the_relational_form(spark):
    pages = read_table(spark, SMALL, "pages")
    rows = dom.blockify(pages)
    a = ft.readability(rows.drop("readability").withColumn("link_density", bl.link_density(F.col("text")))).select("page_id", "pos", F.round("readability", 9).alias("r"))
    b = rows.select("page_id", "pos", F.round("readability", 9).alias("r"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert rows.where("readability > 0").count() > 0


def test_network_inputs(spark):
    html = ["<h1 class='title'>Head</h1><p>By Jane Doe</p><div>More text here.</div><p>End</p>", "<p>only one</p>", "", None]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in ft.network_inputs(pages).collect()}
    assert [len(got[i]["blocks"]) for i in range(4)] == [4, 3, 3, 3]
    assert all(len(x) == 9 for r in got.values() for x in r["f_dense"])
    assert all(len(x) == 43 for r in got.values() for x in r["f_css"])
    assert [b["text"] for b in got[1]["blocks"]] == ["only one"] * 3
    assert [b["text"] for b in got[2]["blocks"]] == ["content", "blocked", "404"]
    assert sum(got[0]["f_css"][0][:35]) > 0
    assert all(sum(x[:35]) == 0 for x in ft.network_inputs(pages, compat=True).first()["f_css"])


def test_features_by_name(spark):
    for name in ("css", "kohlschuetter", "weninger", "readability"):
        assert callable(ft.feature(name))
    assert isinstance(ft.feature("clustered_weninger"), ft.ClusteredRatio)
    with pytest.raises(ValueError, match="unknown"):
        ft.feature("none")
    made = ft.with_features(bl.with_blocks(read_table(spark, SMALL, "pages"))).first()
    assert len(made["f_kohlschuetter"]) == len(made["f_weninger"]) == len(made["f_css"]) == len(made["blocks"])


def test_clusters(spark):
    rows = spark.createDataFrame([(float(i % 4) * 100 + i / 10, float(i % 4) * 50) for i in range(80)], "ratio double, delta double")
    got = ft.ClusteredRatio().fit(rows).transform(rows)
    assert got.where("is_content").count() == 60


def test_author_features(spark):
    rows = dom.blockify(read_table(spark, SMALL, "pages"))
    rows = rows.withColumn("link_density", bl.link_density(F.col("text"))).withColumn("text_density", bl.text_density(F.col("text")))
    made = ft.AuthorFeatures(components=4, hashes=32).fit(rows).transform(rows)
    assert len(made.first()["author_features"]) == 13
    assert made.count() == rows.count()


def test_standardised(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (5.0, 10.0)], "a double, b double")
    got = [r["scaled"].toArray().tolist() for r in ft.standardize(rows, ["a", "b"]).orderBy("a").collect()]
    assert got == [pytest.approx([-1, -1]), pytest.approx([0, 0]), pytest.approx([1, 1])]


def test_softmax_and_candidates(spark):
    rows = bl.with_blocks(spark.createDataFrame([(1, "<p>a</p><p>b</p><p>c</p>")], "page_id long, html string")).withColumn("x", F.array(F.lit(0.0), F.lit(5.0), F.lit(4.0)))
    row = rows.select(decode.softmax(F.col("x")).alias("p"), decode.candidates(F.col("blocks"), F.col("x")).alias("c"), decode.selected(F.col("blocks"), F.col("x")).alias("s")).first()
    assert sum(row["p"]) == pytest.approx(1.0)
    assert [c["text"] for c in row["c"]] == ["b", "c"]
    assert row["s"] == "b\nc"


def test_char_features_and_labels(spark):
    row = spark.createDataFrame([("Al B.", ["B", "I", "O", "B", "I"])], "t string, l array<string>").select(tagging.char_features(F.col("t")).alias("f"), tagging.names_from_labels(F.col("l"), F.col("t")).alias("n")).first()
    assert row["n"] == ["Al", "B"]
    first, third = row["f"][0], row["f"][2]
    assert (first["lower"], first["is_upper"], first["trigram"], first["bigram"], first["next_five"], first["before"], first["after"]) == ("a", True, "al", "a", "al b.", None, "l")
    assert (third["is_space"], third["trigram"], third["before_is_upper"], third["after_is_upper"]) == (True, "l b", False, True)
    assert row["f"][4]["is_symbol"]


def test_labels_in_both_forms(spark):
    from pagelathe.functions.names import from_labels

    cases = [("記者潘乃欣／台北", list("OOBIIOOO")), ("A,B", list("BIB")), ("x", ["O"]), ("", []), ("ab", ["I", "I"]), ("--", ["B", "I"])]
    rows = spark.createDataFrame([(t, labels) for t, labels in cases], "t string, l array<string>")
    got = [r["n"] for r in rows.select(tagging.names_from_labels(F.col("l"), F.col("t")).alias("n")).collect()]
    assert got == [from_labels(labels, t) for t, labels in cases]
    assert got[0] == ["潘乃欣"]


def test_best_labels_and_embeddings(spark):
    rows = spark.createDataFrame([(1, "ab", [{"B": 0.7, "O": 0.3}, {"B": 0.1, "O": 0.9}])], "k long, text string, m array<map<string,double>>")
    assert rows.select(tagging.best_labels(F.col("m")).alias("b")).first()["b"] == ["B", "O"]
    table = spark.createDataFrame([("a", [1.0]), ("UNK", [9.0])], "word string, vector array<double>")
    got = sorted((r["place"], r["vector"][0]) for r in tagging.with_embeddings(rows, table, "k").collect())
    assert got == [(0, 1.0), (1, 9.0)]


def test_neighbours_have_zero_edges(spark):
    row = bl.with_blocks(spark.createDataFrame([(1, "<p>a b</p><p>c</p>")], "page_id long, html string")).select(ft.neighbours(F.col("blocks")).alias("n")).first()
    assert row["n"] == [[0.0, 0.0, 0.5, 2.0, 1.0, 1.0], [0.5, 2.0, 1.0, 1.0, 0.0, 0.0]]
