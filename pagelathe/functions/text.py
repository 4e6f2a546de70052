"""Column functions on text: white space, entities, control characters, casts, title-case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelathe.functions.binding import let
from pagelathe.functions.vocab import BLANK, EMAIL, EMOJI, LONGEST_SINGLE_NAME, LONGEST_VALUE, NAME_CLEANUP, NAME_SEPARATORS, TAG_SEPARATORS

#: The common entities, `&amp;` last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"),
    ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
)


def trim(s: Column) -> Column:
    """Runs of white space become one space; the ends are stripped."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def blanks(s: Column) -> Column:
    """Tokens between ASCII white space, joined by one space."""
    return F.trim(F.regexp_replace(s, BLANK, " "))


def unescape(s: Column) -> Column:
    """The common entities; `&amp;` last, so that nothing is unescaped twice. Most texts have none and stay as they are."""

    def each(held: Column) -> Column:
        out = held
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(held.contains("&"), out).otherwise(held)

    return let(s, each)


@F.pandas_udf(T.StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    """Every HTML entity, numeric ones too."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def repair_encoding(s: pd.Series) -> pd.Series:
    r"""UTF-8 that was read as cp1252 is read again; `\uXXXX` is decoded. Other text stays as it is."""
    import re

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            back = x.encode("cp1252").decode("utf-8")
            x = back if len(back) < len(x) else x
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
        return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x)

    return s.map(one)


def printable(s: Column) -> Column:
    """Without control and other unprintable characters, but for white space."""
    return F.regexp_replace(s, r"[\p{C}&&[^\s]]", "")


def line(s: Column) -> Column:
    """One clean line: entity spaces, control characters and white space; blank gives null."""
    s = F.replace(F.replace(F.replace(s, F.lit("&#13;"), F.lit("\r")), F.lit("&#10;"), F.lit("\n")), F.lit("&nbsp;"), F.lit(" "))
    return F.nullif(trim(printable(s)), F.lit(""))


def cap(s: Column, most: int = LONGEST_VALUE) -> Column:
    """Metadata values are at most `most` characters long, with an ellipsis where something is cut off."""
    held = F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)
    return line(unescape(held))


def to_text(b: Column) -> Column:
    return F.decode(b, "UTF-8")


def to_bytes(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def list_to_text(b: Column) -> Column:
    return F.transform(b, to_text)


def list_to_bytes(s: Column) -> Column:
    return F.transform(s, to_bytes)


def map_to_text(m: Column) -> Column:
    return F.transform_values(F.transform_keys(m, lambda k, _: to_text(k)), lambda _, v: to_text(v))


def map_to_bytes(m: Column) -> Column:
    return F.transform_values(F.transform_keys(m, lambda k, _: to_bytes(k)), lambda _, v: to_bytes(v))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def words(s: Column) -> Column:
    """Alphanumeric tokens, aware of Unicode."""
    return F.filter(F.split(s, r"(?U)[\W_]+"), lambda x: x != "")


def split_tags(s: Column) -> Column:
    """Parts between the first kind of separator found among comma, bar and ideographic comma."""

    def parts(sep: Column) -> Column:
        return F.when(sep == "", F.array(s)).otherwise(F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))))

    found = F.when(s.isNotNull(), let(F.regexp_extract(s, f"({TAG_SEPARATORS})", 1), parts))
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda x: x != "")


def normalize_tags(s: Column) -> Column:
    """Unescaped and trimmed tags without quotes, joined by a comma and a space."""
    clean = F.regexp_replace(trim(unescape(s)), "[\"']", "")
    return F.array_join(F.filter(F.split(clean, ", "), lambda x: x != ""), ", ")


def check_authors(authors: Column, blocked: Column) -> Column:
    """Names separated by semicolons without those of `blocked` (lower case), or null."""
    names = F.filter(F.transform(F.split(authors, ";"), lambda a: F.trim(a)), lambda a: (a != "") & ~F.array_contains(blocked, F.lower(a)))
    return F.nullif(F.array_join(names, "; "), F.lit(""))


def titled(s: Column) -> Column:
    """Title case as Python has it: a letter after anything but a letter is a capital."""
    return F.array_join(F.transform(F.split(s, r"(?<=[^\p{L}])"), F.initcap), "")


def normalize_authors(s: Column) -> Column:
    """Names in a byline: split, what is no name taken off, in title case, none that holds one before it; null without any.

    An address or an e-mail address tells no name. `names.split_names` does the same in plain Python.
    """
    told = F.when(F.lower(s).startswith("http") | s.rlike(f"^(?:{EMAIL})"), F.lit(None)).otherwise(unescape(s))

    def one(name: Column) -> Column:
        for pattern, to in ((EMOJI, ""), *NAME_CLEANUP):
            name = trim(F.regexp_replace(name, f"(?U){pattern}", to))
        return name

    names = F.transform(F.split(told, f"(?U){NAME_SEPARATORS}"), one)
    fair = F.filter(names, lambda a: (a != "") & (a.contains(" ") | a.contains("-") | (F.length(a) < LONGEST_SINGLE_NAME)))
    cased = F.transform(fair, lambda a: F.when(a.rlike(r"^\p{Lu}"), a).otherwise(titled(a)))
    distinct = F.aggregate(cased, F.array().cast("array<string>"), lambda acc, a: F.when(F.exists(acc, lambda x: a.contains(x)), acc).otherwise(F.concat(acc, F.array(a))))
    return F.nullif(F.array_join(distinct, "; "), F.lit(""))


def json_minify(s: Column) -> Column:
    """JSON text without white space outside its strings."""
    return F.regexp_replace(s, r'("(?:\\.|[^"\\])*")|\s', "$1")
