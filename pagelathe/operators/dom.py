"""The tree engine on Arrow batches: exact block features and mined metadata, one parse a page.

A page that cannot be handled gets its error as text in `_error`; the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from pagelathe.runtime import ship_package

_FIELDS = (
    ("pos", "int"), ("start_tag", "string"), ("css_id", "string"), ("css_class", "string"), ("text", "string"), ("tagcount", "bigint"), ("since_last", "bigint"), ("anchors", "bigint"), ("min_depth", "int"),
    ("ancestors", "array<int>"), ("weights", "array<struct<node:int,weight:int>>"), ("readability", "double"), ("extra", "map<string,double>"),
)
BLOCK = f"struct<{','.join(f'{n}:{t}' for n, t in _FIELDS)}>"
META = (
    "struct<title:string,author:string,url:string,hostname:string,description:string,sitename:string,license:string,name:string,"
    "video:string,rawDate:string,categories:array<string>,tags:array<string>,audio:array<string>,og_properties:map<string,string>>"
)
_ARROW_BLOCK = pa.struct([
    ("pos", pa.int32()), ("start_tag", pa.string()), ("css_id", pa.string()), ("css_class", pa.string()), ("text", pa.string()), ("tagcount", pa.int64()), ("since_last", pa.int64()),
    ("anchors", pa.int64()), ("min_depth", pa.int32()), ("ancestors", pa.list_(pa.int32())), ("weights", pa.list_(pa.struct([("node", pa.int32()), ("weight", pa.int32())]))), ("readability", pa.float64()), ("extra", pa.map_(pa.string(), pa.float64())),
])
_ARROW_META = pa.struct([(n, pa.string()) for n in ("title", "author", "url", "hostname", "description", "sitename", "license", "name", "video", "rawDate")] + [(n, pa.list_(pa.string())) for n in ("categories", "tags", "audio")] + [("og_properties", pa.map_(pa.string(), pa.string()))])


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", parse_callback: Callable | None = None, with_meta: bool = True, with_blocks: bool = True, block_features: dict[str, Callable] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """key, dom_blocks, meta and _error of each page. `parse_callback` sees each tree before it is walked.

    `block_features`: by name, a function from the nodes met since the block before to a number; they are in
    the blocks' `extra`. `fields`: those of the blocks that are wanted (None: all); others are not sent from the workers.
    """
    wanted = [(n, t) for n, t in _FIELDS if fields is None or n in fields]
    kind_of_block = pa.struct([_ARROW_BLOCK.field(n) for n, _ in wanted])
    weighed, counted = (any(n == name for n, _ in wanted) for name in ("weights", "extra"))
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelathe.functions import mining, tree, walk

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, meta, errors = [], [], []
                for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    try:
                        root = tree.parse(h or "")
                        if parse_callback is not None:
                            parse_callback(root)
                        blocks = walk.blocks(root, block_features) if with_blocks else None
                        for b in blocks or ():
                            if weighed:
                                b["weights"] = [{"node": n, "weight": w} for n, w in b["weights"]]
                            if counted:
                                b["extra"] = list(b["extra"].items())
                        mined = mining.extract(h, u, root=root) if with_meta else None
                        if mined:
                            mined["og_properties"] = list(mined["og_properties"].items())
                        found.append(blocks)
                        meta.append(mined)
                        errors.append(None)
                    except Exception as e:
                        found.append(None)
                        meta.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(kind_of_block)), pa.array(meta, _ARROW_META), pa.array(errors, pa.string())], ["key", "dom_blocks", "meta", "_error"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, dom_blocks array<struct<{','.join(f'{n}:{t}' for n, t in wanted)}>>, meta {META}, _error string").withColumnRenamed("key", key)


_CSS, _READABILITY = ("css_id", "css_class"), ("ancestors", "weights", "readability")


def blockify(pages: DataFrame, css: bool = True, readability: bool = True, key: str = "page_id", parse_callback: Callable | None = None) -> DataFrame:
    """One row per block of the tree engine, with or without the css and the readability fields."""
    leave = [*(() if css else _CSS), *(() if readability else _READABILITY)]
    rows = parse_pages(pages, key=key, parse_callback=parse_callback, with_meta=False)
    return rows.select(key, F.explode("dom_blocks").alias("b")).select(key, "b.*").drop(*leave)


@udtf(returnType="pos int, start_tag string, text string")
class HtmlBlocks:
    """Table function of one page: its blocks. Register as spark.udtf.register("html_blocks", HtmlBlocks)."""

    def eval(self, html: str):
        from pagelathe.functions import tree, walk

        for b in walk.blocks(tree.parse(html or "")):
            yield b["pos"], b["start_tag"], b["text"]
