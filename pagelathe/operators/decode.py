"""Scores of blocks and their decoding to content, headline and ranked candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelathe.functions.binding import let

TOP, CANDIDATE, BINARY = 10, 0.1, 0.5
#: Fields of a block that `rule_logits` and `decode` read.
RULE_FIELDS = ("start_tag", "css_id", "css_class", "text")
LABELS = ("content", "author", "headline", "breadcrumbs", "date")


def rule_logits(b: Column) -> Column:
    """Transparent default scores of a block: struct of one logit for each label.

    Content: long, dense text with sentence marks that is no link. Headline: a heading. Author and date:
    short texts whose words or css say so. Breadcrumbs: css says so.
    """
    n = F.octet_length(b["text"]) - F.octet_length(F.replace(b["text"], F.lit(" "), F.lit(""))) + 1
    css = F.concat_ws(" ", b["css_id"], b["css_class"])
    heading = b["start_tag"].isin("h1", "h2")
    content = 0.15 * (F.least(n, F.lit(60)) - 12) + F.when(b["text"].rlike(r"[.。!?]$"), 1.0).otherwise(-0.5) + F.when(b["start_tag"] == "a", -3.0).when(heading, -6.0).otherwise(0.0) + F.when(css.rlike("foot|nav|menu|comment|sidebar|ad$"), -2.0).otherwise(0.0)
    author = F.when(css.rlike("author|byline"), 4.0).when(b["text"].rlike("^(?:By|Von) |記者"), 3.0).otherwise(-4.0) - F.when(n > 12, 4.0).otherwise(0.0)
    date = F.when(b["start_tag"] == "time", 4.0).when(b["text"].rlike(r"\b\d{4}[-/.年]\d{1,2}"), 2.0).otherwise(-4.0) - F.when(n > 12, 4.0).otherwise(0.0)
    crumbs = F.when(css.rlike("breadcrumb"), 4.0).otherwise(-4.0)
    return F.struct(content.alias("content"), author.alias("author"), F.when(b["start_tag"] == "h1", 3.0).otherwise(-3.0).alias("headline"), crumbs.alias("breadcrumbs"), date.alias("date"))


def with_logits(pages: DataFrame, scorer: Callable[[Column], Column] = rule_logits) -> DataFrame:
    """Add `logits`, aligned with `blocks`; any function from a block to the five logits serves."""
    return pages.withColumn("logits", F.transform("blocks", scorer))


class OnnxScorer:
    """A user's network: inputs `input[1,n,9]` and `css[1,n,43]`, output `[1,n,5]` in the order of LABELS.

    The driver reads the file and broadcasts it; each Python worker makes one session.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def apply(self, pages: DataFrame) -> DataFrame:
        """`pages` needs f_dense (array of 9 doubles a block) and f_css (43); adds `logits`."""
        with open(self.path, "rb") as file:
            shared = pages.sparkSession.sparkContext.broadcast(file.read())
        kind = pa.list_(pa.struct([(n, pa.float64()) for n in LABELS]))

        # A stage of its own: as a column, the scores could not be used inside expressions on arrays.
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import onnxruntime

            global _SESSION
            if _SESSION is None or _SESSION[0] != shared.value:
                _SESSION = shared.value, onnxruntime.InferenceSession(shared.value)
            session = _SESSION[1]
            for batch in batches:
                out = []
                for x, c in zip(batch.column("f_dense").to_pylist(), batch.column("f_css").to_pylist(), strict=True):
                    raw = session.run(None, {"input": np.array([x], np.float32), "css": np.array([c], np.float32)})[0][0]
                    out.append([dict(zip(LABELS, map(float, r), strict=True)) for r in raw])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "logits"])

        logits = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in LABELS]))
        return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("logits", logits)]))


#: A worker's network: its bytes and session.
_SESSION: tuple | None = None


def pad(blocks: Column) -> Column:
    """At least three blocks: the first and last are repeated around one or two."""
    n = F.size(blocks)
    return F.when(n.between(1, 2), F.concat(F.slice(blocks, 1, 1), blocks, F.slice(blocks, n, 1))).otherwise(blocks)


def softmax(x: Column) -> Column:
    """Over the blocks of a page."""

    def each(held: Column) -> Column:
        raw = let(F.array_max(held), lambda top: F.transform(held, lambda v: F.exp(v - top)))
        return let(raw, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, r: s + r), lambda total: F.transform(e, lambda v: v / total)))

    return let(x, each)


def candidates(blocks: Column, logit: Column, top: int = TOP, least: float = CANDIDATE) -> Column:
    """array<struct<text, score>>: the best `top` blocks by softmax, those above `least`, best first."""

    def ranked(p: Column) -> Column:
        return F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.alias("at"))))

    best = F.filter(F.slice(let(softmax(logit), ranked), 1, top), lambda r: -r["neg"] > least)
    return let(blocks, lambda held: F.transform(best, lambda r: F.struct(F.get(held, r["at"])["text"].alias("text"), (-r["neg"]).alias("score"))))


def selected(blocks: Column, logit: Column) -> Column:
    """Texts of the blocks with sigmoid above one half, a line each; null if there is none."""
    hit = F.filter(F.arrays_zip(blocks.alias("b"), logit.alias("x")), lambda z: z["x"] > 0)
    return F.nullif(F.array_join(F.transform(hit, lambda z: z["b"]["text"]), "\n"), F.lit(""))


def decode(pages: DataFrame, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add content and headline (text) and author, date and breadcrumbs candidates.

    From `logits`, or by `scorer` from each block: then a label that nobody reads is never scored.
    """

    def logit(name: str) -> Column:
        if scorer is not None:
            return F.transform(F.col("blocks"), lambda b: scorer(b)[name].cast("double"))
        return F.transform(F.col("logits"), lambda x: x[name].cast("double"))

    for name in LABELS:
        make = selected if name in ("content", "headline") else candidates
        pages = pages.withColumn(f"ml_{name}", make(F.col("blocks"), logit(name)))
    return pages


def names_of(raw: Column) -> Column:
    """Names in a byline by rules: bylines' words off, split at commas, slashes and 'and'; CJK names in runs."""
    s = F.regexp_replace(raw, r"(?i)^\s*(?:written |posted |words |story )?(?:by|von|por|par)[: ]+", "")
    s = F.regexp_replace(s, "記者|編輯|報導|撰文|文|攝影|專欄|即時|綜合|[〔〕【】（）()]", " ")
    # Words end where no ASCII word character follows, as in SQL; what \b means differs between versions of Java.
    parts = F.split(s, r"(?i)\s*(?:,|;|/|／|、|\||&|(?<![A-Za-z0-9_])(?:and|und)(?![A-Za-z0-9_]))\s*|\s{2,}")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[\s\p{P}]+|[\s\p{P}]+$", "")))
    return F.array_distinct(F.filter(clean, lambda p: (p != "") & ~p.rlike(r"\d") & (F.length(p) <= 50)))


def topk(scores: Column, k: int = TOP) -> Column:
    """array<struct<pos, score>>: the places and scores of the best k of an array in the row, best first, ties by place."""
    ranked = F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.cast("long").alias("pos"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["pos"].alias("pos"), (-r["neg"]).alias("score")))


def topk_rows(rows: DataFrame, key: str, score: str, k: int = TOP) -> DataFrame:
    """The relational form of the ranking: at most k rows a key, best first."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc("pos"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
