"""Metadata rules on hand-written pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import mining, names, text
from pagelathe.functions.tree import parse


def mined(head: str = "", body: str = "<p>x</p><p>y</p>", url: str | None = "https://www.paper.example.com/a") -> dict:
    return mining.extract(f"<html><head>{head}</head><body>{body}</body></html>", url)


def test_full_open_graph_stops_the_search():
    head = "".join(f'<meta property="og:{k}" content="{v}">' for k, v in {"title": "T", "author": "Jane Doe", "url": "https://o.example.org/x", "description": "D", "site_name": "the paper"}.items())
    got = mined(head + '<meta name="keywords" content="a,b"><meta name="author" content="Other">')
    assert (got["title"], got["author"], got["url"], got["description"], got["sitename"]) == ("T", "Jane Doe", "https://o.example.org/x", "D", "The Paper")
    assert got["tags"] == []
    assert got["og_properties"]["site_name"] == "the paper"


def test_named_meta_tags():
    head = (
        '<meta name="citation_title" content="First"><meta name="title" content="Second"><meta name="author" content="jane doe"><meta property="article:author" content="John Roe">'
        '<meta name="description" content="Told"><meta name="twitter:site" content="@desk"><meta name="keywords" content="&quot;a&quot;, b"><meta property="article:tag" content="c|d">'
    )
    got = mined(head)
    assert (got["title"], got["author"], got["description"], got["sitename"]) == ("First", "Jane Doe; John Roe", "Told", "Desk")
    assert got["tags"] == ["a", "b", "c", "d"]
    assert mined(head + '<meta name="publisher" content="House.">')["sitename"] == "House."


def test_itemprops_and_twitter_url():
    got = mined('<meta itemprop="headline" content="H"><meta itemprop="author" content="Jane Doe"><meta name="twitter:url" content="https://t.example.com/x">')
    assert (got["title"], got["author"], got["url"], got["hostname"]) == ("H", "Jane Doe", "https://t.example.com/x", "example.com")


JSON = '<script type="application/ld+json">%s</script>'


def test_json_ld():
    got = mined(JSON % '{"@context":"https://schema.org/","@type":"NewsArticle","headline":"H","author":[{"@type":"Person","name":"jane doe"},{"@type":"Organization","name":"Org"},{"givenName":"John","familyName":"Roe"}],"articleSection":["S"],"datePublished":"2021-03-04","publisher":{"name":"House"}}')
    assert (got["title"], got["name"], got["categories"], got["rawDate"], got["sitename"]) == ("H", "Jane Doe; John Roe", ["S"], "2021-03-04", "House")


@pytest.mark.parametrize(
    ("payload", "field", "want"),
    [
        ('{"@context":"http://schema.org","@graph":[{"@type":"WebSite","name":"Site"},{"@type":"Article","name":"N","headline":"H"}]}', "title", "N"),
        ('{"@context":"http://schema.org","@graph":[{"@type":"WebSite","name":"Site","alternateName":"The Longer Site"}]}', "sitename", "The Longer Site"),
        ('{"@context":"http://schema.org","@type":"LiveBlogPosting","liveBlogUpdate":[{"@type":"BlogPosting","headline":"U"}]}', "title", "U"),
        ('[{"@context":"http://schema.org","@type":["Person"],"name":"Jane Doe"}]', "name", "Jane Doe"),
        ('{"@type":"Article","headline":"without context"}', "title", None),
        ('{"@context":"http://schema.org","@type":"Article","headline":"cut", "author":{"name":"Jane Doe"', "title", "cut"),
        ('{"@context":"http://schema.org","@type":"Article","headline":"cut", "author":{"name":"Jane Doe"', "name", "Jane Doe"),
        ("null", "title", None),
        ("[1, null, {}]", "title", None),
    ],
)
def test_json_ld_forms(payload, field, want):
    assert mined(JSON % payload)[field] == want


def test_one_broken_script_does_not_hide_the_next():
    got = mined(JSON % "{broken" + JSON % '{"@context":"http://schema.org","@type":"Article","headline":"H"}')
    assert got["title"] == "H"


@pytest.mark.parametrize(
    ("head", "body", "want"),
    [
        ("<title>Page - Site</title>", "<h1> Only  head </h1>", "Only head"),
        ("<title>Page - Site</title>", "<h1>a</h1><h1>b</h1>", "Page"),
        ("<title>Page - part-two | Site</title>", "<h1>a</h1><h1>b</h1>", "Page - part-two"),
        ("<title>Page</title>", "", "Page"),
        ("<title>Page</title>", "<h1>a</h1><h1>b</h1><div class='entry-title'>Entry</div>", "Entry"),
        ("", "<h1>a</h1><h1>b</h1>", "a"),
        ("", "<h2>low</h2>", "low"),
        ("", "", None),
    ],
)
def test_titles(head, body, want):
    assert mining.title(parse(f"<html><head>{head}</head><body>{body}</body></html>")) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<a rel='author'>by jane doe</a>", "Jane Doe"),
        ("<p class='byline'>von Jane Doe 12. Mai</p>", "Jane Doe"),
        ("<span class='post-author'>Jane Doe</span>", "Jane Doe"),
        ("<author>jane doe</author>", "Jane Doe"),
        (f"<p class='byline'>{'long ' * 20}</p>", None),
        ("<p>記者潘乃欣／台北報導</p>", "記者潘乃欣／台北報導"),
        ("<p>none</p>", None),
    ],
)
def test_authors(body, want):
    assert mining.author(parse(f"<html><body>{body}</body></html>")) == want


def test_meta_tags_of_the_body_do_not_speak_for_the_page():
    body = '<article><h1>Told</h1></article><div class="comments"><meta itemprop="author" content="A Reader"><meta name="title" content="A comment"><meta name="keywords" content="noise"></div>'
    got = mined('<meta name="author" content="jane doe">', body)
    assert (got["author"], got["title"], got["tags"]) == ("Jane Doe", "Told", [])
    assert mined("", body)["author"] is None


@pytest.mark.parametrize(
    ("author", "want"),
    [
        (r'"{\"@type\": \"Person\", \"name\": \"jane doe\"}"', "Jane Doe"),
        (r'"[{\"name\": \"Jane Doe\"}, {\"name\": \"John Roe\"}]"', "Jane Doe; John Roe"),
        (r'"{broken"', "Broken"),
        ('"jane doe"', "Jane Doe"),
        ('["jane doe", {"@type": "Person", "givenName": "John", "familyName": "Roe"}]', "Jane Doe; John Roe"),
    ],
)
def test_authors_of_json(author, want):
    assert mined(JSON % f'{{"@context":"https://schema.org","@type":"Article","headline":"H","author":{author}}}')["name"] == want


def test_broken_scripts_keep_no_escapes():
    got = mined(JSON % r'{"@type":"Article","headline":"Caf\u00e9 \"open\" again","author":{"name":"Ren\u00e9 Doe"')
    assert (got["title"], got["name"]) == ('Café "open" again', "René Doe")


@pytest.mark.parametrize(
    ("told", "want"),
    [
        ("by jane doe", ["Jane Doe"]),
        ("Written by Jane Doe and John Roe", ["Jane Doe", "John Roe"]),
        ("jane doe | john roe; ann smith", ["Jane Doe", "John Roe", "Ann Smith"]),
        ("Jane Doe (Berlin)", ["Jane Doe"]),
        ("Jane “Red” Doe", ["Jane Doe"]),
        ("J. Doe, 12 May 2021", ["J Doe"]),
        ("von Hans Meier und Eva Lang", ["Hans Meier", "Eva Lang"]),
        ("Jane Doe in Paris", ["Jane Doe"]),
        ("Jane Doe @jane", ["Jane Doe"]),
        ("Mary-Ann O'Brien", ["Mary-Ann O'Brien"]),
        ("words by ann smith", ["Ann Smith"]),
        ("潘乃欣、王小明", ["潘乃欣", "王小明"]),
        ("jane@paper.example.com", []),
        ("https://paper.example.com/jane", []),
        ("", []),
    ],
)
def test_names_in_bylines(told, want):
    assert names.split_names(told) == want


def test_both_name_cleaners_agree(spark):
    told = ["by jane doe and john o'brien, Reporter @x (Berlin)", "Written by J. Doe 12 May; von Hans Meier", "Jane “Red” Doe in Paris | ann smith", "x", "潘乃欣、王小明 und Eva", "a & b & a", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    got = {r["i"]: r["a"] for r in rows.select("i", text.normalize_authors(F.col("t")).alias("a")).collect()}
    assert got == {i: None if t is None else "; ".join(names.joined([], names.split_names(t))) or None for i, t in enumerate(told)}


def test_blocked_author_falls_back_to_the_page():
    assert mined('<meta name="author" content="UDN">', "<span class='author'>Jane Doe</span>")["author"] == "Jane Doe"


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ('<link rel="canonical" href="https://c.example.com/x">', "https://c.example.com/x"),
        ('<link rel="alternate" hreflang="x-default" href="https://d.example.com/x">', "https://d.example.com/x"),
        ('<link rel="canonical" href="/x"><meta property="og:image" content="https://i.example.com/p.png">', "https://i.example.com/x"),
        ('<meta property="og:url" content="https://o.example.com/"><link rel="canonical" href="https://c.example.com/x">', "https://o.example.com/"),
        ('<meta property="og:url" content="x">', "https://www.paper.example.com/a"),
        ("", "https://www.paper.example.com/a"),
        ('<link rel="canonical" href="/x">', None),
    ],
)
def test_addresses(head, want):
    assert mined(head)["url"] == want


def test_sites_and_hosts():
    assert mined()["sitename"] == "paper.example.com"
    assert mined()["hostname"] == "example.com"
    assert mining.domain("https://www.a.co.uk:8080/x") == "a.co.uk"
    assert mining.domain("http://127.0.0.1/") is None
    assert mining.site_from_title(parse("<title>Page - The Site</title>")) == "The Site"


def test_categories_and_tags():
    body = "<div class='post-meta'><a href='/category/x/'>World</a><a href='/other/'>No</a></div><div class='tags'><a href='/tags/a'>One, Two</a></div>"
    got = mined("", body)
    assert (got["categories"], got["tags"]) == (["World"], ["One", "Two"])
    assert mined('<meta property="article:section" content="S">')["categories"] == ["S"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<a rel='license' href='https://creativecommons.org/licenses/by-sa/4.0/'>x</a>", "CC BY-SA 4.0"),
        ("<a rel='license' href='/terms'>Our terms</a>", "Our terms"),
        ("<footer><a href='/l'>under Creative Commons by-nc 3.0 terms</a></footer>", "Creative Commons by-nc 3.0"),
        ("<div id='page-footer'><a href='http://c.org/by/2.0'>x</a></div>", "CC BY 2.0"),
        ("<footer><a href='/terms'>Our terms</a></footer>", None),
    ],
)
def test_licences(body, want):
    assert mined("", body)["license"] == want


@pytest.mark.parametrize(
    ("head", "body", "want"),
    [
        ("", '<iframe id="video" src="https://www.youtube.com/embed/abc?x=1"></iframe>', "https://www.youtube.com/watch?v=abc"),
        ("", '<div data-test="VideoPlaceHolder" class="PlaceHolder-wrapper" data-vilynx-id="7"></div>', "https://player.cnbc.com/p/gZWlPC/cnbc_global?playertype=synd&byGuid=7"),
        ("", """<div class="vxp-media__summary"></div><div class="media-player-wrapper"><figure data-playable='{"settings":{"externalEmbedUrl":"https://v.example.com/1"}}'></figure></div>""", "https://v.example.com/1"),
        ("", '<div class="c-video-embed volume-video" data-volume-uuid="u"></div>', "https://volume.vox-cdn.com/embed/u"),
        ('<meta property="og:video" content="//v.example.com/v.mp4">', "", "https://v.example.com/v.mp4"),
        ('<meta property="og:video" content="https://v.example.com/v.xml">', "", None),
        ("", '<p data-x="https://www.youtube.com/embed/xyz"></p>', "https://www.youtube.com/watch?v=xyz"),
        ("", '<div id="art_video" class="YTplayer" data-ytid="q"></div>', "https://www.youtube.com/watch?v=q"),
        ("", '<video id="video_player"><source src="https://v.example.com/w.mp4"></video>', "https://v.example.com/w.mp4"),
        ("", '<video-player video-type="youtube" source="https://www.youtube.com/embed/z"></video-player>', "https://www.youtube.com/watch?v=z"),
        ("", '<iframe width="0" height="0" content="https://v.example.com/f"></iframe>', None),
        ("", '<iframe width="10" height="20" content="https://v.example.com/f"></iframe>', "https://v.example.com/f"),
        ("", '<iframe width="10" height="20" content="https://www.googletagmanager.com/ns.html"></iframe>', None),
        ("", "", None),
    ],
)
def test_videos(head, body, want):
    assert mined(head, body)["video"] == want


def test_audio():
    body = '<audio src="https://a.example.com/x.mp3"><source src="https://a.example.com/y.ogg"></audio><audio src="z.wav"></audio>'
    assert mined("", body)["audio"] == ["https://a.example.com/x.mp3", "https://a.example.com/y.ogg"]
    assert mined("", '<audio src="x.txt"></audio>')["audio"] == []
    assert mined("", '<audio src="x" type="audio/mpeg"></audio>')["audio"] == ["x"]


def test_values_are_clean_and_capped():
    got = mined(f'<meta name="description" content="{"a" * 20_000}"><meta name="title" content="a&amp;amp;b  &#7; c">')
    assert len(got["description"]) == 10_000
    assert got["description"].endswith("…")
    assert got["title"] == "a&b c"


@pytest.mark.parametrize("raw", [None, "", " ", "<", "<html", "text only", "<!-- -->", "<script>", "\x00", "<a href=>x", "<p" * 500])
def test_odd_pages(raw):
    got = mining.extract(raw)
    assert got["url"] is None
    assert set(got) == {*mining.FIELDS, *mining.LISTS, "og_properties"}


def test_names_from_labels():
    assert names.from_labels(list("BIOB"), "Al/C") == ["Al", "C"]
