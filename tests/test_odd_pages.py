"""Odd pages: the engine's rows are those of the SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from pagelathe.functions import mining, tree
from tests.oracle import duck_rows, spark_rows

CUT = "Ores &amp;&amp; the&amp;&amp;&amp"
PAGES = (
    (1, "https://m.example.com/en/1", f"<!DOCTYPE html><html><head><title>{CUT}</title></head><body><article><h1>{CUT}</h1><p class='c'>{CUT} of the &lt;b&gt; of &copy &quot and many more words that follow here.</p></article></body></html>"),
    (2, "https://m.example.com/en/2", f"<html><head><title>{CUT}</title></head><body><h1>{CUT}</h1><p>a < b and {CUT}<p>c</body></html>"),
)
BYLINES = (
    (3, "https://m.example.com/en/3", "<html><head><title>t</title></head><body><h1>t</h1><p>By Jane Doe undä Roe and\u00e9 Poe und Eva Lang</p></body></html>"),
    (4, "https://m.example.com/en/4", "<html><head><title>t</title></head><body><h1>t</h1><p>Von Hans éund Meier and_x Lang and John Roe</p></body></html>"),
)


def same(spark, folder, name: str, rows) -> None:
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(folder / "pages.parquet")
    assert spark_rows(__spark_entry__.queries()[name](spark, str(folder))) == duck_rows(__spark_entry__.oracle_sql()[name], str(folder))


@pytest.mark.parametrize("name", ["page_metadata", "dom_blocks", "page_records"])
def test_references_that_a_cut_left_without_their_semicolon_stay_as_they_are(spark, tmp_path, name):
    same(spark, tmp_path, name, PAGES)


def test_names_in_bylines_part_at_words_between_letters_beyond_ascii(spark, tmp_path):
    same(spark, tmp_path, "page_records", BYLINES)


@pytest.mark.parametrize("tail", ["", "<"])
def test_references_in_texts_and_attributes(tail):
    """With and without the tolerant tokenizer, which a lone bracket calls for."""
    p = next(tree.parse(f"<p title='a&amp;b&ltc&copy=1&amp' id='&#33;&x;'>&eacute;&eacute &#x41; &#65 &ampx; &amp;lt; &</p>{tail}").iter("p"))
    assert p.attrs == {"title": "a&b&ltc&copy=1&amp", "id": "!&x;"}
    assert p.text == "é&eacute A &#65 &ampx; &lt; &"
    assert mining.extract(f'<head><meta name="title" content="A &amp;copy; B &amp;amp"></head><p>x</p>{tail}')["title"] == "A © B &amp"
