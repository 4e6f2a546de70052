"""Pages to text blocks inside the row: no shuffle, batch and streaming alike.

A block is the text between two opening block tags in document order; closing tags never cut. Each page
keeps an array of block structs, so neighbours are array elements and need no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.binding import let
from pagelathe.functions.text import blanks, unescape
from pagelathe.functions.vocab import BLOCK_TAGS, IGNORED, IGNORED_VOID

_NAMES = "h[1-6]|" + "|".join(t for t in BLOCK_TAGS if t[0] != "h")
FIELDS = ("pos", "start_tag", "css_id", "css_class", "text", "tagcount", "since_last", "anchors", "link_density", "text_density")
_CUT = rf"(?i)(?=<(?:{_NAMES})[\s/>])"
#: A code point that is no character.
_MARK = "\ufdd0"


def clean(html: Column) -> Column:
    """Without comments, declarations and ignored elements; those end at a closer of their own name and part words."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, rf"(?is)<({'|'.join(IGNORED)})(?:\s[^>]*)?>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, rf"(?i)<(?:{'|'.join(IGNORED_VOID)})(?:[\s/][^>]*)?>", " ")
    return F.regexp_replace(c, r"<[!?][^>]*>", "")


def visible(markup: Column) -> Column:
    """Text of markup: tags part tokens, entities are resolved, white space is single."""
    return blanks(unescape(F.regexp_replace(markup, r"<[^>]*>", " ")))


def _attribute(piece: Column, name: str) -> Column:
    found = F.regexp_extract_all(piece, F.lit(rf"(?i)<[a-z][^>]*?\s{name}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.lower(F.array_join(found, " "))


def _cut(html: Column) -> Column:
    """The parts before, between and from the block tags; the first may be empty.

    A split by an expression compiles it anew for each row, one by a single character does not.
    """
    marked = F.split(F.regexp_replace(html, _CUT, _MARK), _MARK)
    return F.when(html.contains(_MARK), F.split(html, _CUT)).otherwise(marked)


def _pieces(text: Column) -> Column:
    """Number of parts between runs of bytes that are no ASCII word characters, empty ones counted."""
    return F.regexp_count(text, F.lit("[^A-Za-z0-9]+")) + 1


def link_density(text: Column, link_text: Column | None = None) -> Column:
    """Parts of the link text over parts of the text; without link text it counts as one empty part."""
    part = F.lit(1) if link_text is None else _pieces(link_text)
    return part / _pieces(text)


def text_density(text: Column) -> Column:
    """Tokens a line of 80 bytes, the last line left out unless it is the only one."""
    lines = F.ceil(F.octet_length(text) / 80).cast("int")
    # Bytes above 127 separate tokens, so a character that is cut in two does no harm.
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), (lines - 1) * 80), "ISO-8859-1")
    return F.when(lines <= 1, _pieces(text).cast("double")).otherwise(_pieces(head) / (lines - 1))


def with_blocks(pages: DataFrame, html: str = "html", link_mode: str = "compat", only: tuple[str, ...] | None = None) -> DataFrame:
    """Add `blocks`: array<struct<pos, start_tag, css_id, css_class, text, tagcount, since_last, anchors, link_density, text_density>>.

    link_mode 'compat' counts a link as an empty text, as links are blocks of their own; 'anchor'
    takes the text of the link that opens the block. `only`: the fields that are wanted; Spark cannot see
    which ones nobody reads, so the others would be computed as well.
    """
    wanted = frozenset(FIELDS if only is None else only)
    if unknown := wanted.difference(FIELDS):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    if link_mode not in ("compat", "anchor"):
        raise ValueError("link_mode must be 'compat' or 'anchor'")

    def piece(s: Column) -> Column:
        start = F.lower(F.regexp_extract(s, rf"(?i)^<({_NAMES})[\s/>]", 1))
        made = {
            "start_tag": lambda: start,
            "css_id": lambda: _attribute(s, "id"),
            "css_class": lambda: _attribute(s, "class"),
            "text": lambda: visible(s),
            "tags": lambda: (F.regexp_count(s, F.lit("<[A-Za-z]")) - F.when(start == "", 0).otherwise(1)).cast("long"),
            "anchors": lambda: F.regexp_count(s, F.lit(r"(?i)<a[\s/>]")).cast("long"),
            "link_text": lambda: F.when(start == "a", visible(F.regexp_extract(s, r"(?is)^<a[^>]*>(.*?)(?:</a\s*>|$)", 1))).otherwise(""),
        }
        used = {"text", *wanted} | ({"tags"} if wanted & {"tagcount", "since_last"} else set()) | ({"link_text"} if "link_density" in wanted and link_mode == "anchor" else set())
        return F.struct(*[make().alias(name) for name, make in made.items() if name in used])

    def block(held: Column, full: Column, at: Column, k: Column) -> Column:
        p = F.get(held, at)

        def since() -> Column:
            """Tags of the pieces without text since the block before; each is looked at once."""
            before = F.when(k > 0, F.get(full, k - 1)).otherwise(-1)
            return F.aggregate(F.slice(held, before + 2, at - before - 1), F.lit(0).cast("long"), lambda n, q: n + q["tags"])

        made = {
            "pos": lambda: k,
            **{name: lambda name=name: p[name] for name in ("start_tag", "css_id", "css_class", "text")},
            "tagcount": lambda: p["tags"],
            "since_last": since,
            "anchors": lambda: p["anchors"],
            "link_density": lambda: link_density(p["text"], p["link_text"]) if link_mode == "anchor" else link_density(p["text"]),
            "text_density": lambda: text_density(p["text"]),
        }
        return F.struct(*[made[name]().alias(name) for name in FIELDS if name in wanted])

    def blocks(held: Column) -> Column:
        """Of the pieces those with text; bound by `let`, so that nothing is computed for each of them anew."""
        places = F.filter(F.transform(held, lambda p, i: F.when(p["text"] != "", i)), lambda i: i.isNotNull())
        return let(places, lambda full: F.transform(full, lambda at, k: block(held, full, at, k)))

    # A select of its own, so that the cleaning runs once.
    cleaned = pages.withColumn("_clean", clean(F.col(html)))
    return cleaned.withColumn("blocks", let(F.transform(_cut(F.col("_clean")), piece), blocks)).drop("_clean")


def explode_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per block: key and the block's fields."""
    return pages.select(key, F.explode("blocks").alias("b")).select(key, "b.*")
