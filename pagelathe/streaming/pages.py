"""Structured Streaming: the same page-local plans on streams, deduplication and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelathe.functions.urls import host, normalize
from pagelathe.runtime import ship_package
from pagelathe.sources.pages import PAGES


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Pages from Parquet files as they arrive."""
    ship_package(spark)
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fresh(pages: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Pages whose normalised URL was not seen within the delay."""
    return pages.withColumn("url_key", normalize(F.col("url"))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["url_key"]).drop("url_key")


def host_counts(pages: DataFrame, at: str = "ts", window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Pages per host and window; late pages within the delay are counted."""
    return pages.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages")).select("w.start", "w.end", "host", "pages")


def write(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append to Parquet, each batch exactly once; ends when all present files are read."""
    out = transform(stream) if transform else stream
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
