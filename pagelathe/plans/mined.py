"""Queries on pages that are made out of the tables' own columns, so that SQL can state what must be mined.

The `pages` table has no metadata but titles. Here each row of a table becomes a page with meta tags,
JSON-LD, links, dates or media around its values; the whole table goes through the operators. Next to each
query stands the answer in DuckDB's SQL, which knows the columns only, not the pages.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelathe.functions import text as tx
from pagelathe.functions import urls
from pagelathe.operators import blocks as bl
from pagelathe.operators import decode, dom, evaluate, merge, tagging
from pagelathe.operators import features as ft
from pagelathe.plans import oracles
from pagelathe.plans.extractor import Extractor, regex_rule
from pagelathe.runtime import read_table, shared_dir, spread
from pagelathe.sources import pages as src
from pagelathe.streaming import pages as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOME = "https://www.paper.example.com/home"


def answer(sql: str):
    """Register a query with the SQL that has the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def join(*parts: str | Column) -> Column:
    """Texts and columns in a row; a null column is an empty text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def turn(key: str, *each: Column) -> Column:
    """The first for keys that the number of alternatives divides, the second for the keys after them, and so on."""
    out = each[0]
    for k, c in enumerate(each[1:], 1):
        out = F.when(F.col(key) % len(each) == k, c).otherwise(out)
    return out


def letters(key: str) -> Column:
    """A key in letters, as names hold no digits."""
    return F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij")


_LETTERS = lambda key: f"translate({key}::VARCHAR, '0123456789', 'abcdefghij')"
_TITLED = lambda e: f"(upper(({e})[1]) || lower(({e})[2:]))"


def page(table: DataFrame, key: str, head: Column | str, body: Column | str = "<p>one</p><p>two</p>", url: Column | str = HOME) -> DataFrame:
    """A page for each row, the rows dealt over all cores before their pages are made."""
    return spread(table, key).select(F.col(key).alias("page_id"), join(url).alias("url"), join("<html><head>", head, "</head><body>", body, "</body></html>").alias("html"))


def mined(pages: DataFrame, *fields: str) -> DataFrame:
    lists = ("categories", "tags", "audio")
    return Extractor().metadata(pages).select("page_id", *[F.array_join(f, ",").alias(f) if f in lists else F.col(f) for f in fields])


# Meta tags


@answer(f"""SELECT p_partkey AS page_id, p_name AS title, p_brand AS author, 'https://shop' || p_size || '.example.co.uk/p/' || p_partkey AS url, 'example.co.uk' AS hostname, 'About ' || p_name AS description,
    CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE {_TITLED('p_type')} END AS sitename, '' AS tags, 5::INT AS n_graph FROM part""")
def meta_opengraph(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages with a full set of OpenGraph tags, which ends the search for others."""
    site = turn("p_partkey", F.col("p_type"), F.lower("p_type"))
    told = {"title": F.col("p_name"), "author": F.col("p_brand"), "url": join("https://shop", F.col("p_size"), ".example.co.uk/p/", F.col("p_partkey")), "description": join(" About  ", F.col("p_name")), "site_name": site}
    head = join(*[x for k, v in told.items() for x in (f'<meta property="og:{k}" content="', v, '">')], '<meta name="keywords" content="a,b">')
    made = Extractor().metadata(page(read_table(spark, d, "part"), "p_partkey", head))
    return made.select("page_id", "title", "author", "url", "hostname", "description", "sitename", F.array_join("tags", ",").alias("tags"), F.size("og_properties").alias("n_graph"))


@answer(f"""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'First ' || c_custkey END AS title, 'Jane ' || {_TITLED(_LETTERS('c_custkey'))} || '; John Roe' AS author,
    'Told of ' || c_name AS description, 'Desk' || c_custkey AS sitename, lower(c_mktsegment) || ',k' || c_custkey || ',c,d' AS tags FROM customer""")
def meta_named(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pages with named meta tags: the first title holds, authors and tags add up. Tags in the body are another's."""
    title = turn("c_custkey", join('<meta property="og:title" content="', F.col("c_mktsegment"), '">'), join('<meta name="citation_title" content="First ', F.col("c_custkey"), '">'))
    head = join(
        title, '<meta name="title" content="Second"><meta name="author" content="by jane ', letters("c_custkey"), '"><meta property="article:author" content="John Roe"><meta name="description" content="Told of ', F.col("c_name"),
        '"><meta name="twitter:site" content="@desk', F.col("c_custkey"), '"><meta name="keywords" content="', F.lower("c_mktsegment"), ", k", F.col("c_custkey"), '"><meta property="article:tag" content="c|d">',
    )
    body = '<p>a</p><div class="comments"><meta name="author" content="A Reader"><meta name="keywords" content="noise"></div>'
    return mined(page(read_table(spark, d, "customer"), "c_custkey", head, body), "title", "author", "description", "sitename", "tags")


@answer("""SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' entry' WHEN 2 THEN p_name || ' - part' WHEN 3 THEN p_name WHEN 4 THEN p_type END AS title FROM part""")
def title_rules(spark: SparkSession, d: str) -> DataFrame:
    """A sole h1, a marked element, the title without its last part, the first h1, the first h2; a long marked element is none."""
    name = F.col("p_name")
    two = ("<h1>", name, "</h1><h1>other</h1>")
    body = turn("p_partkey", join("<h1> ", name, " </h1>"), join(*two, "<div class='entry-title'>", F.col("p_brand"), " entry</div>"), join(*two), join(*two), join("<h2>", F.col("p_type"), "</h2><h2>x</h2>"), join("<p class='post-title'>", "x" * 250, "</p>"))
    head = turn("p_partkey", F.lit("<title>Page - Site</title>"), F.lit("<title>Page - Site</title>"), join("<title>", name, " - part | Site</title>"), F.lit(""), F.lit(""), F.lit(""))
    return mined(page(read_table(spark, d, "part"), "p_partkey", head, body), "title")


_CC = "(ARRAY['by', 'by-sa', 'by-nc-nd', 'zero'])[(p_size % 4 + 1)::INT]"


@answer(f"""SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN 'CC ' || upper({_CC}) || ' ' || (1 + p_size % 4) || '.0' WHEN 1 THEN 'Terms of ' || p_brand WHEN 2 THEN 'Creative Commons ' || {_CC} || ' 3.0'
    WHEN 3 THEN 'CC ' || upper({_CC}) || ' 2.0' END AS license FROM part""")
def licence_links(spark: SparkSession, d: str) -> DataFrame:
    """Licences by marked link (address or text) and by links in footers; other footer links state none."""
    kind = F.element_at(F.array(*map(F.lit, ("by", "by-sa", "by-nc-nd", "zero"))), (F.col("p_size") % 4 + 1).cast("int"))
    body = turn(
        "p_partkey", join("<a rel='license' href='https://creativecommons.org/licenses/", kind, "/", 1 + F.col("p_size") % 4, ".0/'>x</a>"), join("<a rel='license' href='/terms'>Terms of ", F.col("p_brand"), "</a>"),
        join("<footer><a href='/l'>under Creative Commons ", kind, " 3.0 terms</a></footer>"), join("<div id='page-footer'><a href='http://c.org/", kind, "/2.0'>x</a></div>"), join("<footer><a href='/terms'>Our terms</a></footer>"),
    )
    return mined(page(read_table(spark, d, "part"), "p_partkey", "", body), "license")


@answer(f"""SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 6 < 4 THEN 'Jane ' || {_TITLED(_LETTERS('s_suppkey'))} WHEN s_suppkey % 6 = 4 THEN '記者潘乃欣／台北報導' END AS author FROM supplier""")
def author_rules(spark: SparkSession, d: str) -> DataFrame:
    """Authors by rel, byline, class and element, or a byline in running text; a long element is no name, a blocked meta tag neither."""
    name = join("jane ", letters("s_suppkey"))
    body = turn(
        "s_suppkey", join("<a rel='author'>by ", name, "</a>"), join("<p class='byline'>von ", name, " 12. Mai</p>"), join("<span class='post-author'>", name, "</span>"), join("<author>", name, "</author>"),
        F.lit("<p>記者潘乃欣／台北報導</p>"), join("<p class='byline'>", "long " * 20, "</p>"),
    )
    return mined(page(read_table(spark, d, "supplier"), "s_suppkey", '<meta name="author" content="UDN">', body), "author")


@answer("""SELECT n_nationkey AS page_id, CASE n_nationkey % 7 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Jane Doe; John Roe' WHEN 2 THEN 'Hans Meier; Eva Lang' WHEN 3 THEN 'J Doe' WHEN 4 THEN 'Jane Doe' WHEN 5 THEN 'Jane Doe' END AS authors FROM nation""")
def byline_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the cleaning of names, with a value of the row where it must go."""
    nation = F.col("n_name")
    told = turn("n_nationkey", join("by jane doe in ", nation), join("Written by Jane Doe (", nation, ") and john roe @", nation), join("von Hans Meier und Eva Lang"), join("J. Doe, 12 May ", nation), join("Jane “", nation, "” Doe"), join("Jane Doe & Jane Doe 🎉"), join("jane@", F.translate(nation, "_", "-"), ".example.com"))
    return read_table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), tx.normalize_authors(told).alias("authors"))


@answer("""WITH u AS (SELECT c_custkey AS page_id, CASE c_custkey % 6 WHEN 0 THEN 'https://c.example.com/' || c_custkey WHEN 1 THEN 'https://d.example.org/' || c_custkey WHEN 2 THEN 'https://i.example.net/r' || c_custkey
    WHEN 3 THEN 'https://o.example.co.jp/' || c_custkey ELSE 'https://www.paper.example.com/home' END AS url FROM customer)
    SELECT page_id, url, regexp_extract(url, '(example\\.(?:co\\.jp|[a-z]+))/', 1) AS hostname FROM u""")
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Canonical link, x-default link, relative link with the site of a meta tag, OpenGraph, an unsound one, none."""
    key = F.col("c_custkey")
    head = turn(
        "c_custkey", join('<link rel="canonical" href="https://c.example.com/', key, '">'), join('<link rel="alternate" hreflang="x-default" href="https://d.example.org/', key, '">'),
        join('<link rel="canonical" href="/r', key, '"><meta property="og:image" content="https://i.example.net/p.png">'), join('<meta property="og:url" content="https://o.example.co.jp/', key, '"><link rel="canonical" href="https://c.example.com/x">'),
        F.lit('<meta property="og:url" content="x">'), F.lit(""),
    )
    return mined(page(read_table(spark, d, "customer"), "c_custkey", head), "url", "hostname")


@answer("""SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE '' END AS categories, CASE p_partkey % 3 WHEN 2 THEN p_brand || ',' || p_type ELSE '' END AS tags FROM part""")
def link_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of links in marked elements or of article:section, tags of links."""
    body = turn(
        "p_partkey", join("<div class='post-meta'><a href='/category/x/'>", F.col("p_type"), "</a><a href='/other/'>No</a></div>"), F.lit("<a href='/category/x/'>unmarked</a><p>x</p>"),
        join("<div class='tags'><a href='/tags/a'>", F.col("p_brand"), ", ", F.col("p_type"), "</a></div>"),
    )
    head = turn("p_partkey", F.lit(""), join('<meta property="article:section" content="', F.col("p_brand"), '">'), F.lit(""))
    return mined(page(read_table(spark, d, "part"), "p_partkey", head, body), "categories", "tags")


@answer("""SELECT p_partkey AS page_id, p_name || ' & ' || p_brand AS title, CASE p_partkey % 2 WHEN 0 THEN p_type || ' sold' ELSE 'paper.example.com' END AS sitename FROM part""")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    """Values unescaped once more than the page, without control characters and runs of blanks; the host where no site is told."""
    head = join('<meta name="citation_title" content="', F.col("p_name"), " &amp;amp;  ", "\x07", F.col("p_brand"), '">', turn("p_partkey", join('<meta name="publisher" content="', F.col("p_type"), ' sold">'), F.lit("")))
    return mined(page(read_table(spark, d, "part"), "p_partkey", head), "title", "sitename")


# JSON-LD


def _script(*parts: str | Column) -> Column:
    return join('<script type="application/ld+json">', *parts, "</script>")


_ARTICLES = {
    "news": ('{"@context":"https://schema.org/","@type":"NewsArticle","headline":"', "name", '","author":[{"@type":"Person","name":"jane ', "letters", '"},{"@type":"Organization","name":"Org"},{"givenName":"John","familyName":"Roe"}],"articleSection":["', "segment", '"],"datePublished":"2021-03-04","publisher":{"name":"House"}}'),
    "graph": ('{"@context":"http://schema.org","@graph":[{"@type":"WebSite","name":"Site","alternateName":"The ', "segment", ' Site"},{"@type":"Article","name":"', "name", '","headline":"H","author":"jane ', "letters", '"}]}'),
    "live": ('{"@context":"http://schema.org","@type":"LiveBlogPosting","liveBlogUpdate":[{"@type":"BlogPosting","headline":"', "name", '","author":"{\\"@type\\":\\"Person\\",\\"name\\":\\"jane ', "letters", '\\"}"}]}'),
    "list": ('[{"@context":"http://schema.org","@type":["Person"],"name":"Jane ', "letters", '"},{"@context":"http://schema.org","@type":"Report"}]'),
    "other": ('{"@type":"Article","headline":"without context"}',),
    "broken": ('{"@context":"http://schema.org","@type":"Article","headline":"', "name", ' \\u00e9","articleSection":"', "segment", '","author":{"@type":"Person","name":"jane ', "letters", '"'),
}


def _customers(spark: SparkSession, d: str) -> DataFrame:
    values = {"name": F.col("c_name"), "letters": letters("c_custkey"), "segment": F.col("c_mktsegment")}
    scripts = [_script(*[values.get(p, p) for p in parts]) for parts in _ARTICLES.values()]
    return page(read_table(spark, d, "customer"), "c_custkey", turn("c_custkey", *scripts))


@answer(f"""WITH n AS (SELECT c_custkey AS page_id, c_custkey % 6 AS k, c_name, c_mktsegment AS s, 'Jane ' || {_TITLED(_LETTERS('c_custkey'))} AS jane, 'Jane ' || {_LETTERS('c_custkey')} AS as_is FROM customer)
    SELECT page_id, CASE WHEN k < 3 THEN c_name WHEN k = 5 THEN c_name || ' é' END AS title, CASE k WHEN 0 THEN jane || '; John Roe' WHEN 3 THEN as_is WHEN 4 THEN NULL ELSE jane END AS name,
    CASE k WHEN 0 THEN s WHEN 5 THEN s ELSE '' END AS categories, CASE k WHEN 0 THEN '2021-03-04' END AS "rawDate", CASE k WHEN 0 THEN 'House' WHEN 1 THEN 'The ' || s || ' Site' ELSE 'paper.example.com' END AS sitename FROM n""")
def json_ld_fields(spark: SparkSession, d: str) -> DataFrame:
    """An article, a graph, a live blog with JSON in a text, a list, one without context, a broken one."""
    return mined(_customers(spark, d), "title", "name", "categories", "rawDate", "sitename")


@answer("""SELECT c_custkey AS page_id, u AS n, CASE c_custkey % 6 WHEN 0 THEN 'NewsArticle' WHEN 1 THEN CASE u WHEN 1 THEN 'Article' ELSE 'WebSite' END WHEN 2 THEN 'LiveBlogPosting' WHEN 3 THEN CASE u WHEN 1 THEN 'Report' ELSE '["Person"]' END ELSE 'Article' END AS kind
    FROM (SELECT c_custkey, unnest(range(CASE WHEN c_custkey % 6 = 5 THEN 0 WHEN c_custkey % 6 IN (1, 3) THEN 2 ELSE 1 END)) AS u FROM customer)""")
def json_ld_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the payloads, those of a graph or a list on their own, in the order of their kinds."""
    rows = src.ld_json_objects(_customers(spark, d)).select("page_id", F.get_json_object("object", "$.@type").alias("kind"))
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("kind"), lambda a, b: F.when(a < b, F.when(a.startswith("["), 1).otherwise(-1)).when(a == b, 0).otherwise(1)).alias("kinds"))
    # '[' sorts after letters
    ordered = F.concat(F.filter("kinds", lambda k: k.startswith("[")), F.array_sort(F.filter("kinds", lambda k: ~k.startswith("["))))
    put = F.when(F.exists("kinds", lambda k: k == "WebSite"), F.reverse(ordered)).otherwise(ordered)
    return listed.select("page_id", F.posexplode(put).alias("n", "kind")).select("page_id", F.col("n").cast("long").alias("n"), "kind")


@answer("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 6 = 4 THEN NULL ELSE c_custkey % 6 END AS script, '{"name":"' || c_name || '","n":[1,2],"t":"a b \\" c"}' AS small FROM customer""")
def json_minified(spark: SparkSession, d: str) -> DataFrame:
    """JSON without blanks outside its strings, and which of the scripts has a context."""
    raw = join('{ "name" : "', F.col("c_name"), '",\n "n": [1,\t2], "t": "a b \\" c" }')
    key = F.col("c_custkey") % 6
    told = F.when(F.get(src.ld_json(turn("c_custkey", *[_script(*parts) for parts in _ARTICLES.values()])), F.lit(0)).contains("@context"), key)
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), told.alias("script"), tx.json_minify(raw).alias("small"))


# Dates


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@answer(f"""SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN {_DAY} || 'T10:20:30Z' WHEN 1 THEN {_DAY} WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 3 THEN {_DAY} WHEN 4 THEN {_DAY} WHEN 5 THEN strftime(o_orderdate, '%Y年%-m月%-d日') END AS "rawDate",
    CASE WHEN o_orderkey % 7 < 6 THEN o_orderdate::DATE END AS day FROM orders""")
def dates_found(spark: SparkSession, d: str) -> DataFrame:
    """Dates of meta tags, time elements, JSON-LD, marked elements, the address; none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    head = turn("o_orderkey", join('<meta property="article:published_time" content="', day, 'T10:20:30Z">'), F.lit(""), F.lit(""), _script('{"@context":"https://schema.org","@type":"Article","datePublished":"', day, '"}'), F.lit(""), F.lit(""), F.lit(""))
    body = turn("o_orderkey", F.lit("<p>x</p>"), join("<time datetime='", day, "'>then</time>"), join("<time>", F.date_format("o_orderdate", "d MMMM yyyy"), "</time>"), F.lit("<p>x</p>"), F.lit("<p>x</p>"), join("<p class='entry-date'>", F.date_format("o_orderdate", "yyyy'年'M'月'd'日'"), "</p>"), F.lit("<p class='date'>soon</p>"))
    url = turn("o_orderkey", F.lit(HOME), F.lit(HOME), F.lit(HOME), F.lit(HOME), join("https://www.paper.example.com/", F.date_format("o_orderdate", "yyyy/MM/dd"), "/story"), F.lit(HOME), F.lit(HOME))
    return mined(page(read_table(spark, d, "orders"), "o_orderkey", head, body, url), "rawDate").withColumn("day", urls.parse_date(F.col("rawDate")).cast("date"))


@answer("""WITH u AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 AS k, 2000 + o_orderkey % 20 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 31 AS d FROM orders)
    SELECT o_orderkey AS page_id, CASE k WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN make_date(y, m, least(d, day(last_day(make_date(y, m, 1))))::BIGINT)
      WHEN 2 THEN make_date(y, m, least(day(o_orderdate), day(last_day(make_date(y, m, 1))))::BIGINT) ELSE make_date(y, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(y, month(o_orderdate), 1))))::BIGINT) END AS date,
      'Order ' || o_orderkey AS title, 'Mined' AS author FROM u""")
def record_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Whole records: mined values before scored ones, and what the address says of the date before both."""
    key = F.col("o_orderkey")
    y, m, day = 2000 + key % 20, 1 + key % 12, F.lpad((1 + key % 31).cast("string"), 2, "0")
    url = turn("o_orderkey", F.lit(HOME), join("https://www.paper.example.com/", y, "/", m, "/", day, "/x"), join("https://www.paper.example.com/", y, "/", m, "/x"), join("https://www.paper.example.com/", y, "/x"))
    head = join('<title>Order ', key, ' - Paper</title><meta name="date" content="', F.date_format("o_orderdate", "yyyy-MM-dd"), '"><meta name="author" content="mined">')
    body = join("<p class='author'>By Shown Name</p><p>", "many words of a long paragraph " * 4, "</p><time>1 Jan 1990</time>")
    return Extractor(fields=("date", "title", "author"))(page(read_table(spark, d, "orders"), "o_orderkey", head, body, url)).select("page_id", F.col("date").cast("date").alias("date"), "title", "author")


# Media


@answer("""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'https://a.example.com/' || p_partkey || '.mp3,https://a.example.com/y.ogg' WHEN 2 THEN 'spoken' || p_partkey WHEN 3 THEN '' ELSE '' END AS audio FROM part""")
def media_audio(spark: SparkSession, d: str) -> DataFrame:
    """The first audio element: an address with a known ending or type, and the sources inside it."""
    key = F.col("p_partkey")
    body = turn("p_partkey", join('<audio src="https://a.example.com/', key, '.mp3"><source src="https://a.example.com/y.ogg"></audio><audio src="z.wav"></audio>'), F.lit('<audio src="x.txt"></audio>'), join('<audio src="spoken', key, '" type="audio/mpeg"></audio>'), F.lit("<p>x</p>"))
    return mined(page(read_table(spark, d, "part"), "p_partkey", "", body), "audio")


_WATCH = "'https://www.youtube.com/watch?v=k' || p_partkey"


@answer(f"""SELECT p_partkey AS page_id, CASE p_partkey % 14 WHEN 0 THEN {_WATCH} WHEN 1 THEN 'https://player.cnbc.com/p/gZWlPC/cnbc_global?playertype=synd&byGuid=' || p_partkey WHEN 2 THEN 'https://v.example.com/' || p_partkey
    WHEN 3 THEN 'https://volume.vox-cdn.com/embed/' || p_partkey WHEN 4 THEN 'https://v.example.com/' || p_partkey || '.mp4' WHEN 6 THEN {_WATCH} WHEN 7 THEN {_WATCH} WHEN 8 THEN 'https://v.example.com/' || p_partkey || '.mp4'
    WHEN 9 THEN {_WATCH} WHEN 11 THEN 'https://v.example.com/f' || p_partkey END AS video FROM part""")
def media_video(spark: SparkSession, d: str) -> DataFrame:
    """Each rule for videos, addresses that are no video, empty frames, a blocked host, and none."""
    key = F.col("p_partkey")
    body = turn(
        "p_partkey", join('<iframe id="video" src="https://www.youtube.com/embed/k', key, '?x=1"></iframe>'), join('<div data-test="VideoPlaceHolder" class="PlaceHolder-wrapper" data-vilynx-id="', key, '"></div>'),
        join("<div class=\"vxp-media__summary\"></div><div class=\"media-player-wrapper\"><figure data-playable='{\"settings\":{\"externalEmbedUrl\":\"https://v.example.com/", key, "\"}}'></figure></div>"),
        join('<div class="c-video-embed volume-video" data-volume-uuid="', key, '"></div>'), F.lit("<p>x</p>"), F.lit("<p>x</p>"), join('<p data-x="https://www.youtube.com/embed/k', key, '"></p>'), join('<div id="art_video" class="YTplayer" data-ytid="k', key, '"></div>'),
        join('<video id="video_player"><source src="https://v.example.com/', key, '.mp4"></video>'), join('<video-player video-type="youtube" source="https://www.youtube.com/embed/k', key, '"></video-player>'),
        join('<iframe width="0" height="0" content="https://v.example.com/f', key, '"></iframe>'), join('<iframe width="10" height="20" content="https://v.example.com/f', key, '"></iframe>'),
        join('<iframe width="10" height="20" content="https://www.googletagmanager.com/ns', key, '.html"></iframe>'), F.lit("<p>x</p>"),
    )
    ends = {4: ".mp4", 5: ".xml"}
    head = turn("p_partkey", *[join('<meta property="og:video" content="//v.example.com/', key, f'{ends[k]}">') if k in ends else F.lit("") for k in range(14)])
    return mined(page(read_table(spark, d, "part"), "p_partkey", head, body), "video")


# Sources, casts and repairs


_CODECS = ("gb2312", "big5", "shift_jis", "euc-kr", "utf-8", "iso-8859-1", "utf-16")
_WORDS = ("新闻零件", "新聞零件", "ニュース部品", "뉴스부품", "新聞 ニュース", "Café Größe", "naïve €")


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([t.encode(n) for t, n in zip(text, name, strict=True)])


def _coded(spark: SparkSession, d: str) -> DataFrame:
    word, codec = (turn("p_partkey", *map(F.lit, x)) for x in (_WORDS, _CODECS))
    html = join('<html><head><meta charset="', codec, '"></head><body><p>', word, " ", F.col("p_name"), "</p></body></html>")
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), _encoded(html, codec).alias("markup"))


@answer(f"""SELECT p_partkey AS page_id, ({list(_WORDS)})[(p_partkey % 7 + 1)::INT] || ' ' || p_name AS text FROM part""")
def legacy_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Pages in Chinese, Japanese, Korean and Western encodings, by the encoding that they state or that their first bytes show."""
    rows = _coded(spark, d).select("page_id", src.to_html(F.col("markup")).alias("html"))
    return rows.select("page_id", F.regexp_extract("html", "<p>(.*)</p>", 1).alias("text"))


@answer("""SELECT p_partkey AS page_id, CASE p_partkey % 7 WHEN 4 THEN 'utf-8' WHEN 5 THEN 'iso-8859-1' WHEN 6 THEN 'iso-8859-1' ELSE (['gb2312', 'big5', 'shift_jis', 'euc-kr'])[(p_partkey % 7 + 1)::INT] || ',iso-8859-1' END AS names FROM part""")
def encoding_names(spark: SparkSession, d: str) -> DataFrame:
    """Encodings that may be tried: UTF-8 alone where the bytes are that, else the stated one and latin-1."""
    return _coded(spark, d).select("page_id", F.array_join(src.encoding_candidates(F.col("markup")), ",").alias("names"))


@answer("""SELECT n_nationkey AS page_id, n_nationkey % 4 IN (1, 3) AS is_page, CASE WHEN n_nationkey % 4 IN (1, 3) THEN n_name END AS title FROM nation""")
def page_rejection(spark: SparkSession, d: str) -> DataFrame:
    """What is no page has no metadata: a text, one element alone, nothing."""
    name = F.col("n_name")
    html = turn("n_nationkey", name, join("<html><h1>", name, "</h1></html>"), join("<h1>", name, "</h1>"), join("<div><h1>", name, "</h1></div>"))
    pages = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), F.lit(HOME).alias("url"), html.alias("html"))
    return Extractor().metadata(pages.withColumn("was", src.is_page(F.col("html"))), keep=["was"]).select("page_id", F.col("was").alias("is_page"), "title")


@answer("""SELECT c_custkey AS page_id, c_name AS one, c_name || ',' || c_mktsegment AS many, c_mktsegment AS held FROM customer""")
def text_casts(spark: SparkSession, d: str) -> DataFrame:
    """Texts, lists and maps to bytes and back."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    back = tx.map_to_text(tx.map_to_bytes(F.create_map(name, segment)))
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), tx.to_text(tx.to_bytes(name)).alias("one"), F.array_join(tx.list_to_text(tx.list_to_bytes(F.array(name, segment))), ",").alias("many"), F.get(F.map_values(back), F.lit(0)).alias("held"))


@answer("""SELECT p_partkey AS page_id, 'Café ' || p_name AS repaired, 'é ' || p_name || '!' AS entities, p_name || ' ' || p_brand AS shown, p_name || ' - ' || p_type AS line, replace(p_name, ' ', ',') || ',' || replace(p_brand, '#', ',') AS words FROM part""")
def text_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Text read in the wrong encoding, all entities, control characters, one clean line, alphanumeric words."""
    name = F.col("p_name")
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), tx.repair_encoding(join("CafÃ© ", name)).alias("repaired"), tx.unescape_all(join("&eacute; ", name, "&#33;")).alias("entities"), tx.printable(join(name, "\x07 \x01", F.col("p_brand"))).alias("shown"),
        tx.line(join(" ", name, "&nbsp;-\n ", F.col("p_type"), "&#10;")).alias("line"), F.array_join(tx.words(join(name, "--", F.col("p_brand"))), ",").alias("words"),
    )


# Scores, names and merging


@answer("""SELECT p_partkey AS page_id, replace(p_name, ' ', ',') AS names, 'B' AS label FROM part""")
def names_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names from a label a character: a word's first character begins a name, the others go on with it."""
    chars = tagging.characters(F.col("p_name"))
    first = F.transform(chars, lambda c, i: F.when(c == " ", "O").when((i == 0) | (F.get(chars, i - 1) == " "), "B").otherwise("I"))
    best = tagging.best_labels(F.array(F.create_map(F.lit("O"), F.lit(0.2), F.lit("B"), F.lit(0.7), F.lit("I"), F.lit(0.1))))
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.array_join(tagging.names_from_labels(first, F.col("p_name")), ",").alias("names"), F.get(best, F.lit(0)).alias("label"))


@answer("""SELECT p_partkey AS page_id, length(p_brand)::BIGINT AS n_chars, len(regexp_extract_all(p_brand, '[aeiou]'))::BIGINT AS n_known, len(regexp_extract_all(p_brand, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(p_brand, '[0-9]'))::BIGINT AS n_digits,
    '#' || regexp_extract(p_brand, '#(.)', 1) AS pair FROM part""")
def character_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a name tagger: vectors of known characters, else that of UNK, and features of single characters."""
    table = spark.createDataFrame([(c, [1.0, float(i)]) for i, c in enumerate("aeiou")] + [("UNK", [0.0, 0.0])], "word string, vector array<double>")
    parts = read_table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("text"))
    known = tagging.with_embeddings(parts, table, "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_chars"), F.sum(F.get("vector", F.lit(0))).cast("long").alias("n_known"))
    count = lambda test: F.size(F.filter("f", test)).cast("long")
    marked = F.get(F.filter("f", lambda x: x["lower"] == "#"), F.lit(0))
    told = parts.select("page_id", tagging.char_features(F.col("text")).alias("f")).select("page_id", count(lambda x: x["is_upper"]).alias("n_upper"), count(lambda x: x["is_digit"]).alias("n_digits"), F.concat(marked["lower"], marked["after"]).alias("pair"))
    return known.join(told, "page_id")


@answer("""SELECT event_id AS page_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'told' END AS label, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END::INT AS n_keys, event_type || ',' || 'x' AS listed, event_id % 2 = 1 AND event_id % 3 = 0 AS whole FROM events""")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    """Maps of which the second wins but for its nulls, lists in a row, and whether all fields are there."""
    told = F.when(F.col("event_id") % 2 == 1, F.lit("told"))
    third = F.when(F.col("event_id") % 3 == 0, F.lit("third"))
    none = F.lit(None).cast("string")
    held = merge.merge_maps(F.create_map(F.lit("label"), F.col("event_type"), F.lit("more"), F.lit("x")), F.create_map(F.lit("label"), told, F.lit("last"), F.when(third.isNull(), F.lit("y")).otherwise(none)))
    return read_table(spark, d, "events").select(F.col("event_id").alias("page_id"), held["label"].alias("label"), F.size(held).alias("n_keys"), F.array_join(merge.append(F.array("event_type"), F.array(F.lit("x"))), ",").alias("listed"), merge.complete(told, third).alias("whole"))


@answer("""WITH s AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS e, avg(p_retailprice) AS n, stddev_samp(p_retailprice) AS f FROM part)
    SELECT p_partkey AS page_id, round((p_size - m) / e, 5) AS size, round((p_retailprice - n) / f, 5) AS price FROM part, s""")
def standardized(spark: SparkSession, d: str) -> DataFrame:
    """Columns to zero mean and unit deviation."""
    made = ft.standardize(read_table(spark, d, "part"), ["p_size", "p_retailprice"]).withColumn("v", vector_to_array("scaled"))
    return made.select(F.col("p_partkey").alias("page_id"), F.round(F.get("v", F.lit(0)), 5).alias("size"), F.round(F.get("v", F.lit(1)), 5).alias("price"))


@answer("""SELECT event_id AS page_id, round(1 / (1 + exp(-(value - 5) / 4)), 6) AS p, CASE WHEN value > 5 THEN event_type || chr(10) || 'always' ELSE 'always' END AS content FROM events""")
def sigmoid_content(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose sigmoid is above one half are the content."""
    x = (F.col("value") - 5) / 4
    blocks = F.array(*[F.struct(F.col("event_type").alias("text")) if i == 0 else F.struct(F.lit(t).alias("text")) for i, t in enumerate(("", "always", "never"))])
    return read_table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.round(tx.sigmoid(x), 6).alias("p"), decode.selected(blocks, F.array(x, F.lit(1.0), F.lit(-1.0))).alias("content"))


@answer("""WITH e AS (SELECT event_id, event_type, greatest(least(value, 9), -9)::DOUBLE AS x FROM events), s AS (SELECT event_id, event_type, exp(x) / (exp(x) + exp(2) + exp(1) + exp(-9)) AS p, exp(2) / (exp(x) + exp(2) + exp(1) + exp(-9)) AS two, exp(1) / (exp(x) + exp(2) + exp(1) + exp(-9)) AS one FROM e)
    SELECT event_id AS page_id, rank, text, round(score, 6) AS score FROM (
      SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, spot) AS rank, text, score FROM (SELECT event_id, 0 AS spot, event_type AS text, p AS score FROM s UNION ALL SELECT event_id, 1, 'two', two FROM s UNION ALL SELECT event_id, 2, 'one', one FROM s) u) r
    WHERE rank <= 2 AND score > 0.1""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best two blocks by softmax, above a tenth."""
    x = F.greatest(F.least(F.col("value"), F.lit(9)), F.lit(-9)).cast("double")
    blocks = F.array(F.struct(F.col("event_type").alias("text")), *[F.struct(F.lit(t).alias("text")) for t in ("two", "one", "least")])
    rows = read_table(spark, d, "events").select(F.col("event_id").alias("page_id"), F.posexplode(decode.candidates(blocks, F.array(x, F.lit(2.0), F.lit(1.0), F.lit(-9.0)), top=2)).alias("at", "c"))
    return rows.select("page_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("c.text").alias("text"), F.round("c.score", 6).alias("score"))


ORACLES["lcs_inclusion"] = """WITH RECURSIVE t AS (SELECT conv_id, turn, string_split(text, ' ') AS x, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations),
    l AS (
      SELECT conv_id, turn, x, y, 0 AS i, list_transform(y, lambda v: 0) AS r FROM t WHERE y IS NOT NULL
      UNION ALL
      SELECT conv_id, turn, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN x[i + 1] = y[k] THEN CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + 1 ELSE r[k] END))) FROM l WHERE i < len(x)
    )
    SELECT conv_id, turn, list_max(r)::BIGINT AS lcs, len(x) AS n_tokens FROM l WHERE i = len(x)"""


@answer("""SELECT item_id AS page_id, len(string_split(text, ' ')) + 1 AS n_lines, 1::BIGINT AS n_new, true AS same FROM benchmark""")
def lcs_diffs(spark: SparkSession, d: str) -> DataFrame:
    """A passage against itself with one more word."""
    x = F.split("text", " ")
    diff = evaluate.lcs_diff(x, F.concat(F.array(F.lit("newword")), x))
    rows = read_table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"), x.alias("x"), diff.alias("d"))
    kept = F.transform(F.filter("d", lambda t: t.startswith("  ")), lambda t: F.substring(t, 3, 1 << 30))
    return rows.select("page_id", F.size("d").cast("long").alias("n_lines"), F.size(F.filter("d", lambda t: t.startswith("+ "))).cast("long").alias("n_new"), (kept == F.col("x")).alias("same"))


# Extension points and streams


@answer("""SELECT c_custkey AS page_id, pos::BIGINT AS pos, (CASE pos WHEN 0 THEN 2 ELSE 0 END)::DOUBLE AS depth, (CASE pos WHEN 1 THEN length(c_name) ELSE 0 END)::DOUBLE AS told FROM customer, (VALUES (0), (1), (2)) AS v(pos)""")
def walk_features(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the user's from the nodes of each block: how many are bold, and the length of an attribute."""
    rows = page(read_table(spark, d, "customer"), "c_custkey", "", join("<p>a <b>b</b> <b>c</b></p><p data-name='", F.col("c_name"), "'>d</p><p>e</p>"))
    made = dom.parse_pages(rows, with_meta=False, block_features={"bold": _bold, "told": _told}, fields=("pos", "extra")).select("page_id", F.explode("dom_blocks").alias("b"))
    return made.select("page_id", F.col("b.pos").cast("long").alias("pos"), F.col("b.extra")["bold"].alias("depth"), F.col("b.extra")["told"].alias("told"))


def _bold(nodes) -> float:
    return sum(n.tag == "b" for n in nodes)


def _told(nodes) -> float:
    return sum(len(n.get("data-name") or "") for n in nodes)


@answer(f"""SELECT s_suppkey AS page_id, 'No. ' || s_suppkey AS license, 'Jane ' || {_TITLED(_LETTERS('s_suppkey'))} || ',Second' AS author, length('Jane ' || {_LETTERS('s_suppkey')})::INT AS n FROM supplier""")
def user_hooks(spark: SparkSession, d: str) -> DataFrame:
    """A rule of the user where mining found nothing, an author extractor of the user, and a column of the user."""
    name = join("Jane ", letters("s_suppkey"))
    body = join("<p data-order='No. ", F.col("s_suppkey"), "'>", name, "</p><p>", "some words of a text ", "</p>")
    made = Extractor(
        scorer=lambda b: F.struct(F.lit(0.0).alias("content"), *[F.when(b["pos"] == 0, 9.0).otherwise(-9.0).alias(x) for x in ("author", "headline")], F.lit(0.0).alias("date"), F.lit(0.0).alias("breadcrumbs")),
        author_extractor=lambda raw: F.array(tx.titled(raw), F.lit("Second")),
        meta_postprocess=[{"license": regex_rule("data-order='([^']*)'")}],
        postprocess=[lambda df: df.withColumn("n", F.length("headline"))],
    )(page(read_table(spark, d, "supplier"), "s_suppkey", "", body))
    return made.select("page_id", "license", "author", "n")


@answer("SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) AS host, count(*) AS n_pages FROM pages GROUP BY 1")
def streamed_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a stream, written in micro-batches that are counted by host afterwards.

    A stream reads folders or patterns, so the table is named by a pattern.
    """
    from uuid import uuid4

    at = f"{shared_dir(spark)}/pagelathe/stream-{uuid4().hex}"
    streams.write(streams.read_pages(spark, f"{d}/pages.parque[t]"), f"{at}/out", f"{at}/log", lambda p: p.select("page_id", urls.host(F.col("url")).alias("host"))).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))


@answer("SELECT * FROM (SELECT page_id, 3::INT AS n, 'h1,p,a' AS tags FROM pages)")
def html_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The table function on a made page of each address."""
    spark.udtf.register("html_blocks", dom.HtmlBlocks)
    read_table(spark, d, "pages").select("page_id", join("<h1>a</h1><p>", F.col("page_id"), "</p><a href='x'>y</a>").alias("html")).createOrReplaceTempView("_made_pages")
    rows = spark.sql("SELECT page_id, b.pos, b.start_tag FROM _made_pages, LATERAL html_blocks(html) b")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "start_tag"))), lambda x: x["start_tag"]), ",").alias("tags"))


@answer("""SELECT c_custkey AS page_id, 0::BIGINT AS pos, 1::DOUBLE AS compat, 1::DOUBLE AS anchor FROM customer UNION ALL SELECT c_custkey, 1, 0.5::DOUBLE, 1::DOUBLE FROM customer""")
def link_modes(spark: SparkSession, d: str) -> DataFrame:
    """A link counts as an empty text, or with its own text; the second block is all link."""
    rows = page(read_table(spark, d, "customer"), "c_custkey", "", "<p>word</p><a href='x'>two words</a>")
    for mode in ("compat", "anchor"):
        rows = bl.with_blocks(rows, link_mode=mode, only=("link_density",)).withColumn(mode, F.transform("blocks", lambda b: F.round(b["link_density"], 6)))
    return rows.select("page_id", F.posexplode(F.arrays_zip("compat", "anchor")).alias("pos", "z")).select("page_id", F.col("pos").cast("long").alias("pos"), "z.compat", "z.anchor")


_METADATA = """SELECT page_id, h1 AS title, NULL::VARCHAR AS author, url, domain AS hostname, NULL::VARCHAR AS description, regexp_extract(url, '^https?://(?:www\\.|w[0-9]+\\.)?([^/]+)', 1) AS sitename,
    NULL::VARCHAR AS license, NULL::VARCHAR AS video, NULL::VARCHAR AS "rawDate", '' AS tags, '' AS categories, NULL::VARCHAR AS _error"""
ORACLES["page_metadata"] = f"""WITH t AS ({oracles.ORACLES["page_title"]}), h AS ({oracles.ORACLES["url_host"]}) {_METADATA} FROM (SELECT p.page_id, p.url, t.title AS h1, h.domain FROM pages p JOIN t USING (page_id) JOIN h USING (page_id))"""
_LOGIT = """0.15 * (least(len(string_split(text, ' ')), 60) - 12) + CASE WHEN regexp_matches(text, '[.。!?]$') THEN 1.0 ELSE -0.5 END + CASE WHEN start_tag = 'a' THEN -3.0 WHEN start_tag IN ('h1', 'h2') THEN -6.0 ELSE 0.0 END
    + CASE WHEN regexp_matches(concat_ws(' ', css_id, css_class), 'foot|nav|menu|comment|sidebar|ad$') THEN -2.0 ELSE 0.0 END"""
ORACLES["article_token_f1"] = oracles.PLAIN + f""", c AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS content FROM b WHERE {_LOGIT} > 0 GROUP BY 1),
    x AS (SELECT p.page_id, list_distinct(string_split_regex(coalesce(content, ''), '\\s+')) AS p, list_distinct(string_split({oracles.blanks(oracles.unescape("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))}, ' ')) AS a FROM pages p LEFT JOIN c ON c.page_id = p.page_id),
    r AS (SELECT page_id, len(list_intersect(p, a)) / len(p)::DOUBLE AS p, len(list_intersect(p, a)) / len(a)::DOUBLE AS r FROM x)
    SELECT page_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r"""

_AUTHOR = """CASE WHEN regexp_matches(concat_ws(' ', css_id, css_class), 'author|byline') THEN 4.0 WHEN regexp_matches(text, '^(?:By|Von) |記者') THEN 3.0 ELSE -4.0 END - CASE WHEN len(string_split(text, ' ')) > 12 THEN 4.0 ELSE 0.0 END"""
_BARE = """regexp_replace(regexp_replace(text, '(?i)^\\s*(?:written |posted |words |story )?(?:by|von|por|par)[: ]+', ''), '記者|編輯|報導|撰文|文|攝影|專欄|即時|綜合|[〔〕【】（）()]', ' ', 'g')"""
_PARTS = f"""list_transform(string_split_regex({_BARE}, '(?i)\\s*(?:,|;|/|／|、|\\||&|\\band\\b|\\bund\\b)\\s*|\\s{{2,}}'), lambda p: trim(regexp_replace(p, '^[\\s\\p{{P}}]+|[\\s\\p{{P}}]+$', '', 'g')))"""
ORACLES["page_records"] = oracles.PLAIN + f""", c AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS content FROM b WHERE {_LOGIT} > 0 GROUP BY 1),
    l AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS headline FROM b WHERE start_tag = 'h1' GROUP BY 1),
    e AS (SELECT page_id, pos, text, exp(x - max(x) OVER (PARTITION BY page_id)) AS e FROM (SELECT page_id, pos, text, {_AUTHOR} AS x FROM b) u),
    s AS (SELECT *, e / sum(e) OVER (PARTITION BY page_id) AS p, row_number() OVER (PARTITION BY page_id ORDER BY e DESC, pos) AS nth FROM e),
    n AS (SELECT page_id, {_PARTS} AS ns FROM s WHERE nth = 1 AND p > 0.1),
    a AS (SELECT page_id, nullif(array_to_string(list_filter(ns, lambda x, i: x <> '' AND NOT regexp_matches(x, '\\d') AND length(x) <= 50 AND list_position(ns, x) = i), ','), '') AS author FROM n),
    m AS ({ORACLES["page_metadata"]})
    SELECT m.page_id, m.title, a.author, m.url, m.hostname, m.sitename, m.license, NULL::DATE AS date, c.content, l.headline, m._error FROM m LEFT JOIN a USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN l USING (page_id)"""
