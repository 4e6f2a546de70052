"""Reading pages, guessing their encoding, and writing records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelathe.runtime import ship_package

PAGES = "page_id long, url string, html string"
_CHARSET = {"utf8": "UTF-8", "utf-8": "UTF-8", "ascii": "US-ASCII", "us-ascii": "US-ASCII", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "windows-1252": "ISO-8859-1", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-32": "UTF-32"}

#: Names that stand for a larger set of characters.
_LARGER = {"gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "big5": "big5hkscs"}


@F.pandas_udf(T.StringType())
def _by_codec(markup: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes by a codec of Python; latin-1 for an unknown name. Null stays null."""
    import codecs

    def one(b: bytes | None, n: str) -> str | None:
        if b is None:
            return None
        try:
            known = codecs.lookup(_LARGER.get(n, n))
        except LookupError:
            known = codecs.lookup("latin-1")
        return b.decode(known.name if known._is_text_encoding else "latin-1", "replace")

    return pd.Series([one(b, n) for b, n in zip(markup, name, strict=True)], dtype=object)


def guess_encoding(markup: Column, default: str = "utf-8") -> Column:
    """The name in an XML declaration of the first 1024 bytes, else in a meta charset of the first
    2048 bytes or 5 %, else `default`."""
    head = F.decode(F.substring(markup, 1, 1024), "ISO-8859-1")
    more = F.decode(F.substring(markup, F.lit(1), F.greatest(F.lit(2048), (F.octet_length(markup) * 0.05).cast("int"))), "ISO-8859-1")
    xml = F.regexp_extract(head, r"""(?i)^\s*<\?xml[^>]*?encoding\s*=\s*["']([^"']+)["']""", 1)
    meta = F.regexp_extract(more, r"""(?i)<\s*meta[^>]+charset\s*=\s*["']?([^>"'\s/;]+)""", 1)
    return F.when(xml != "", xml).when(meta != "", meta).otherwise(F.lit(default))


def to_html(markup: Column, default: str = "utf-8") -> Column:
    """Bytes as text: UTF-8 where valid, UTF-16 with its mark, else by the guessed encoding, else latin-1.

    Only bytes in an encoding that Spark does not know go through Python.
    """
    valid, marked = F.is_valid_utf8(markup.cast("string")), F.hex(F.substring(markup, 1, 2)).isin("FFFE", "FEFF")
    name = F.lower(guess_encoding(markup, default))
    foreign = ~valid & ~marked & ~name.isin(*_CHARSET)
    text = F.when(foreign, _by_codec(F.when(foreign, markup), name)).otherwise(F.decode(markup, "ISO-8859-1"))
    text = F.when(marked, F.decode(markup, "UTF-16")).otherwise(text)
    for known in ("UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        text = F.when(name.isin(*[k for k, v in _CHARSET.items() if v == known]), F.decode(markup, known)).otherwise(text)
    return F.when(valid, markup.cast("string")).otherwise(text)


def is_page(html: Column) -> Column:
    """False for what cannot be a page: fewer than two elements and no 'html' in the first 50 characters."""
    return F.coalesce((F.regexp_count(html, F.lit(r"<[A-Za-z]")) >= 2) | F.lower(F.substring(html, 1, 50)).contains("html"), F.lit(False))


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(path)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One page a file: url is the path, page_id a hash of it."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), to_html(F.col("content")).alias("html"))


def from_list(spark: SparkSession, pages: list[str]) -> DataFrame:
    """A small list of pages, numbered from 0."""
    return spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)], PAGES)


def ld_json(html: Column) -> Column:
    """Payloads of the JSON-LD scripts, as text."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1))


def ld_json_objects(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, object: one row per JSON-LD object as text, those of an @graph or an array on their own; broken scripts give none."""
    scripts = pages.select(key, F.explode(ld_json(F.col(html))).alias("j"))
    listed = F.when(F.trim("j").startswith("["), F.from_json("j", "array<string>")).otherwise(F.array("j"))
    items = scripts.select(key, F.explode(listed).alias("j")).where(F.try_parse_json("j").isNotNull())
    inner = F.get_json_object("j", "$.@graph")
    graph = F.when(inner.startswith("["), F.from_json(inner, "array<string>")).when(inner.isNotNull(), F.array(inner)).otherwise(F.array("j"))
    return items.select(key, F.explode(graph).alias("object"))


def encoding_candidates(markup: Column, default: str = "utf-8") -> Column:
    """utf-8 alone if the bytes are that, else the stated encoding and then latin-1."""
    stated = F.lower(guess_encoding(markup, default))
    others = F.filter(F.array_distinct(F.array(stated, F.lit("iso-8859-1"))), lambda x: ~x.isin("utf-8", "utf8", "utf_8"))
    return F.when(F.is_valid_utf8(markup.cast("string")), F.array(F.lit("utf-8"))).otherwise(others)


def write_records(records: DataFrame, path: str, kind: str = "parquet") -> None:
    records.write.format(kind).save(path)
