"""Merging results with an explicit order of precedence, and the final checks of a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.binding import let
from pagelathe.functions.urls import override_date, parse_date
from pagelathe.operators.decode import names_of


def prefer(main: Column, other: Column) -> Column:
    """`main` where it is not null."""
    return F.coalesce(main, other)


def complete(*columns: Column) -> Column:
    """Whether every one of the fields is there."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def append(a: Column, b: Column) -> Column:
    """Both lists, one after the other; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(a, empty), F.coalesce(b, empty))


def merge_maps(x: Column, main: Column) -> Column:
    """Keys of both maps; those of `main` win, and its null values count as absent."""
    held = F.map_filter(main, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(held, k)), held)


def last_date(found: Column) -> Column:
    """Of the candidates the last that can be read as a date: struct(text, score, date)."""
    dated = F.transform(found, lambda c: F.struct(c["text"].alias("text"), c["score"].alias("score"), parse_date(c["text"]).alias("date")))
    kept = F.filter(dated, lambda c: c["date"].isNotNull())
    return let(kept, lambda k: F.get(k, F.size(k) - 1))


#: Fields of a record that only mining states, and those for which scores stand in.
MINED = frozenset(("url", "hostname", "description", "sitename", "license", "name", "video", "audio", "categories", "tags", "og_properties"))
MINED_FIRST = ("title", "author", "rawDate", "date")


def needs_scores(meta: Column, fields: tuple[str, ...]) -> Column:
    """Whether scores of blocks play a part in any of these fields of a record."""
    if not MINED.union(MINED_FIRST).issuperset(fields):
        return F.lit(True)
    found = [let(meta["rawDate"], parse_date) if f == "date" else meta[f] for f in fields if f in MINED_FIRST]
    return ~complete(*found)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", names: Callable[[Column], Column] = names_of) -> DataFrame:
    """One record a page from decoded labels and `meta`; mined values win over scored ones.

    `names`: the names that the best author candidate's text holds, as a list.
    """
    meta, top, date = F.col("meta"), F.col("_top"), F.col("_date")
    address = F.coalesce(meta["url"], F.col(url))
    pages = pages.select("*", F.get("ml_author", F.lit(0)).alias("_top"), last_date(F.col("ml_date")).alias("_date"), let(meta["rawDate"], parse_date).alias("_mined"))
    mined = F.col("_mined")
    return pages.select(
        key,
        prefer(meta["title"], F.col("ml_headline")).alias("title"),
        F.coalesce(meta["author"], F.nullif(F.array_join(names(top["text"]), ","), F.lit(""))).alias("author"),
        top["text"].alias("rawAuthor"),
        top["score"].alias("authorConfidence"),
        address.alias("url"),
        meta["hostname"].alias("hostname"),
        meta["description"].alias("description"),
        meta["sitename"].alias("sitename"),
        meta["license"].alias("license"),
        meta["name"].alias("name"),
        meta["video"].alias("video"),
        meta["audio"].alias("audio"),
        meta["categories"].alias("categories"),
        meta["tags"].alias("tags"),
        meta["og_properties"].alias("og_properties"),
        F.transform("ml_breadcrumbs", lambda c: c["text"]).alias("breadcrumbs"),
        F.coalesce(meta["rawDate"], date["text"]).alias("rawDate"),
        F.when(mined.isNull(), date["score"]).alias("dateConfidence"),
        let(F.coalesce(mined, date["date"]), lambda d: override_date(d, address)).alias("date"),
        F.col("ml_content").alias("content"),
        F.col("ml_headline").alias("headline"),
        "_error",
    )
