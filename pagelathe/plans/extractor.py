"""The whole dataflow: pages to records, with hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.operators.blocks import with_blocks
from pagelathe.operators.decode import RULE_FIELDS, OnnxScorer, decode, names_of, rule_logits
from pagelathe.operators.dom import META, parse_pages
from pagelathe.operators.features import network_inputs
from pagelathe.operators.merge import needs_scores, records
from pagelathe.runtime import free_name
from pagelathe.sources.pages import is_page


def regex_rule(pattern: str, group: int = 1) -> Callable[[Column], Column]:
    """A rule for `meta_postprocess`: a group of the first match of a Java pattern in the page; null without one."""
    return lambda html: F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


@dataclass
class Extractor:
    """Callable on a DataFrame of pages (page_id, url, html).

    scorer: from a block to its logits; or network: a model file on the inputs of `network_inputs`. meta_postprocess: column builders by field of the record, used
    where mining found nothing (earlier ones win). postprocess: from the records to new columns, which
    may only add names. fields: those of the record that are wanted (None: all); where mining found them all, nothing is scored. author_extractor: from the text of the best author candidate to its names. What
    cannot be a page (`is_page`) has no metadata. Page-local work stays in the row, so there is no shuffle but for the tree
    engine's join-free second column; streams take the same calls.
    """

    scorer: Callable[[Column], Column] = rule_logits
    network: OnnxScorer | None = None
    author_extractor: Callable[[Column], Column] = names_of
    meta_postprocess: list[dict[str, Callable[[Column], Column]]] = field(default_factory=list)
    postprocess: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    parse_callback: Callable | None = None
    link_mode: str = "compat"
    fields: tuple[str, ...] | None = None

    def __call__(self, pages: DataFrame) -> DataFrame:
        return self.extract(pages)

    def metadata(self, pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Mined metadata alone, with the columns of `pages` that `keep` names."""
        held = keep or []
        packed = pages.select(F.struct("page_id", F.struct(*held).alias("keep") if held else F.lit(0).alias("keep"), is_page(F.col("html")).alias("sound")).alias("page"), "url", "html")
        mined = parse_pages(packed, key="page", parse_callback=self.parse_callback, with_blocks=False)
        meta = mined.select("page.*", F.when(F.col("page.sound"), F.col("meta")).alias("meta"), "_error")
        return meta.select("page_id", *[F.col(f"keep.{c}") for c in held], "meta.*", "_error")

    def extract(self, pages: DataFrame) -> DataFrame:
        packed = pages.select(F.struct("page_id", "url", "html").alias("page"))
        # The tree engine passes the page through its key, so that nothing is joined back.
        packed = packed.select("page", F.col("page.url").alias("url"), F.col("page.html").alias("html"))
        if self.network is not None:
            mined = self.network.apply(network_inputs(packed, key="page", with_meta=True))
        else:
            mined = parse_pages(packed, key="page", parse_callback=self.parse_callback, with_blocks=False)
        rows = mined.select("page.*", F.when(is_page(F.col("page.html")), F.col("meta")).alias("meta"), "_error", *(("blocks", "logits") if self.network is not None else ()))
        for callbacks in self.meta_postprocess:
            for name, make in callbacks.items():
                rows = rows.withColumn("meta", F.col("meta").withField(name, F.coalesce(F.col(f"meta.{name}"), make(F.col("html")))))
        if self.network is None:
            if self.fields is not None:
                rows = rows.withColumn("html", F.when(needs_scores(F.col("meta"), self.fields), F.col("html")))
            rows = with_blocks(rows, link_mode=self.link_mode, only=RULE_FIELDS if self.scorer is rule_logits else None)
        out = records(decode(rows, self.scorer if self.network is None else None), names=self.author_extractor)
        if self.fields is not None:
            out = out.select("page_id", *self.fields, "_error")
        for more in self.postprocess:
            held = free_name(out, "record")
            added = more(out.withColumn(held, F.struct(*out.columns)))
            if held not in added.columns:
                raise ValueError("postprocess must keep the columns it is given")
            out = added.select(f"{held}.*", *[c for c in added.columns if c != held and c not in out.columns])
        return out


def extract_news(pages: DataFrame) -> DataFrame:
    """Records with the default settings."""
    return Extractor()(pages)


__all__ = ["META", "Extractor", "extract_news", "regex_rule"]
