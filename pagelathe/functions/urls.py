"""Column functions on URLs: validity, host, domain, normal form, and dates in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.binding import let
from pagelathe.functions.vocab import DATE_PATTERNS, MONTHS, SECOND_LEVEL


def host(url: Column) -> Column:
    """Host and port as written, without user information; null without a scheme."""
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def is_valid(url: Column) -> Column:
    """http or https, a host of at least 5 characters, at least 8 if it begins with www."""
    h = F.coalesce(host(url), F.lit(""))
    return F.coalesce(url.rlike("^https?://") & (F.length(h) >= 5) & ~(h.startswith("www.") & (F.length(h) < 8)), F.lit(False))


def domain(url: Column) -> Column:
    """The registered domain: two labels, three where names are registered below a country's second level."""
    h = F.lower(F.regexp_replace(host(url), r":\d+$", ""))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    below = two.rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    return F.when(below & (n > 2), three).otherwise(two)


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, single slashes, the query's filled parts sorted; the fragment stays."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    h = F.regexp_replace(F.lower(host(url)), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*([^?#]*)", 1), "/+", "/")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    parts = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x.rlike("=."))), "&")
    return F.concat(scheme, F.lit("://"), h, path, F.when(parts == "", "").otherwise(F.concat(F.lit("?"), parts)), F.when(fragment == "#", "").otherwise(fragment))


def path_date(url: Column) -> Column:
    """struct(year, month, day) from the path; -1 where it has none, null without any date."""
    out = None
    for pattern in DATE_PATTERNS:
        groups = pattern.count("(")
        month = F.regexp_extract(url, pattern, 2) if groups > 1 else F.lit("")
        number = F.when(month.rlike(r"^\d+$"), F.expr("1") * F.try_to_number(F.lpad(month, 2, "0"), F.lit("99")).cast("int")).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month), F.lit(0)), F.lit(-1)).cast("int"))
        day = F.regexp_extract(url, pattern, 3) if groups > 2 else F.lit("")
        one = F.struct(
            F.regexp_extract(url, pattern, 1).cast("int").alias("year"),
            F.when(month == "", -1).otherwise(number).alias("month"),
            F.when(day == "", -1).otherwise(F.nullif(day, F.lit("")).cast("int")).alias("day"),
        )
        here = F.when(url.rlike(pattern), one)
        out = here if out is None else F.coalesce(out, here)
    return out


def override_date(date: Column, url: Column) -> Column:
    """`date` with the parts its URL's path states; a day past the month's end becomes its last."""

    def with_path(d: Column) -> Column:
        year = F.when(d["year"] > 100, d["year"]).otherwise(F.year(date))
        month = F.when(d["month"].between(1, 12), d["month"]).otherwise(F.month(date))
        day = F.when(d["day"].between(1, 31), d["day"]).otherwise(F.dayofmonth(date))
        last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
        return F.when(d.isNull() | date.isNull(), date.cast("date")).otherwise(F.make_date(year, month, F.least(day, last)))

    return F.when(date.isNotNull(), let(path_date(url), with_path))


_YMD, _HM = r"^[+-]?\d{4,}%s\d\d%s\d\d", r"\d\d:\d\d"
#: Spellings of dates in the order in which they are tried, each with a shape that every text it can read has.
_SPELLINGS = (
    ("yyyy-MM-dd'T'HH:mm:ssXXX", _YMD % ("-", "-") + rf"[Tt]{_HM}:\d\d[^.]"), ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", _YMD % ("-", "-") + rf"[Tt]{_HM}:\d\d\.\d"), ("yyyy-MM-dd'T'HH:mm:ss", _YMD % ("-", "-") + rf"[Tt]{_HM}:\d\d$"),
    ("yyyy-MM-dd HH:mm:ss", _YMD % ("-", "-") + rf" {_HM}:\d\d$"), ("yyyy-MM-dd HH:mm", _YMD % ("-", "-") + rf" {_HM}$"), ("yyyy-MM-dd", _YMD % ("-", "-") + "$"),
    ("yyyy/MM/dd HH:mm", _YMD % ("/", "/") + rf" {_HM}$"), ("yyyy/MM/dd", _YMD % ("/", "/") + "$"), ("yyyy.MM.dd", _YMD % (r"\.", r"\.") + "$"),
    ("d MMM yyyy HH:mm:ss Z", r"^[+-]?\d+ \p{L}{3,4} .*:\d\d [+-]"), ("d MMM yyyy HH:mm:ss z", r"^[+-]?\d+ \p{L}{3,4} .*:\d\d \S"), ("d MMM yyyy", r"^[+-]?\d+ \p{L}{3,4} \S*$"), ("d MMMM yyyy", r"^[+-]?\d+ \p{L}{3,} \S*$"),
    ("MMM d, yyyy", r"^\p{L}{3,4} [+-]?\d+, \S*$"), ("MMMM d, yyyy", r"^\p{L}{3,} [+-]?\d+, \S*$"), ("yyyy'年'M'月'd'日'", r"^[+-]?\d{4,}年"),
)


def parse_date(s: Column) -> Column:
    """A timestamp from the usual spellings, or null.

    A text that a spelling cannot read costs Java an exception, so each is tried on texts of its shape alone.
    """
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3}, ", "")
    return F.when(s.isNotNull(), let(bare, lambda b: F.coalesce(*[F.when(b.rlike(shape), F.try_to_timestamp(b, F.lit(f))) for f, shape in _SPELLINGS])))
