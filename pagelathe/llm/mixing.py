"""Mixing sources to target weights, in DataFrame operations.

Tokens are summed per source, a budget is shared by weight with a ceiling per source, and each
document is emitted floor(rate) times plus one Bernoulli copy whose probability is the fraction of
the rate. The draw is a hash of the seed, the document's id and, for rows that repeat an id, the
row's number among them, so reruns agree.

Ceilings: a source's target stops at `ceiling` times its tokens; what it cannot take is shared among
the others by weight until no target is above its ceiling. That is water filling: with sources in
the order of ceiling / weight, the level is where the running sums meet the budget, so two running
sums over the per-source totals solve it in one pass.

Scale: the shuffle carries one row per source and task, and narrow rows for the few ids that repeat.
Sources may be many (hosts): they are ranked and summed in ranges, and only ranges' totals are gathered.
Rates go back to the documents by a join on the source; a hot source is split by adaptive execution.

Defined results: a null text has no tokens; null is a source of its own, ordered last. A document
without tokens is emitted by the same rule. Sources without tokens have target 0 and their documents
are taken 0 times. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.numbering import gapless, running
from pagelathe.runtime import free_name, materialize

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
CEILING = 2.0
SEED = 20240229


def word_count(text: Column) -> Column:
    """Number of words; Java's regular expressions count the same code points."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Strings compare by their UTF-8 bytes in Spark, which is the order of code points.
    """
    held = materialize(totals.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1)), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = running(held, ["none", "source"], {"rank": "one"}).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    caps = materialize(caps.withColumn("bound", F.col("cap") / F.col("weight")), "mix-caps")
    whole = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(whole["size"]) * F.lit(float(budget)) - (F.col("caps_to") - F.col("cap"))) / (F.lit(whole["weight"]) - (F.col("weights_to") - F.col("weight")))
    # The level if this source and all with higher bounds are unbounded; the first that bears it sets it.
    caps = materialize(running(caps, ["bound", "none", "source"], {"caps_to": "cap", "weights_to": "weight"}).withColumn("level_here", level), "mix-levels")
    found = caps.agg(F.max(F.when(F.col("level_here") <= F.col("bound"), F.col("level_here"))).alias("level")).first()["level"]
    target = F.coalesce(F.least(F.col("cap"), F.lit(found).cast("double") * F.col("weight")), F.col("cap")) if found is not None else F.col("cap")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return caps.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _uniform(seed: int, id_col: Column, size: Column, nth: Column) -> Column:
    """A number in [0, 1): the first 52 bits of an MD5 digest, which any SQL engine can repeat."""
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), size.cast("string"), nth.cast("string"))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _numbered(frozen: DataFrame) -> DataFrame:
    """`frozen` (id, size, source, row) with `nth`: the row's number among the rows of its id, 0 for most.

    Which of the rows of an id has which number may differ between runs only where those rows have
    equal size and source, that is, where they are interchangeable.
    """
    same = ["id", "size", "source"]
    repeats = frozen.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if repeats.isEmpty():
        return frozen.withColumn("nth", F.lit(0).cast("long"))
    repeats = materialize(repeats, "mix-repeats")
    on = frozen["id"].eqNullSafe(repeats["id"]) & frozen["size"].eqNullSafe(repeats["size"]) & frozen["source"].eqNullSafe(repeats["source"])
    once = frozen.join(repeats, on, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    more = materialize(frozen.join(repeats, on, "left_semi"), "mix-repeated")
    return once.unionByName(gapless(more, same, ["row"], "nth"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, copies, taken."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row"))
    frozen = materialize(narrow, "mix")
    totals = frozen.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(totals, weights, budget, ceiling).withColumnRenamed("source", "rate_source")
    joined = _numbered(frozen).join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    draw = _uniform(seed, F.col("id"), F.col("size"), F.col("nth"))
    joined = joined.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as `plan` says, with the columns of `docs`.

    Repetition happens row by row after the rates, in the task that holds the row. Rows that repeat an
    id draw together here, as their texts need not be equal.
    """
    size, src = free_name(docs, "mix_size"), free_name(docs, "mix_source")
    totals = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(totals, weights, budget, ceiling).select(F.col("source").alias(src), F.col("rate").alias(size))
    joined = docs.join(rates, docs[source_col].eqNullSafe(rates[src]))
    draw = _uniform(seed, docs[id_col], word_count(docs[text_col]), F.lit(0).cast("long"))
    copies = (F.floor(rates[size]) + F.when(draw < rates[size] - F.floor(rates[size]), 1).otherwise(0)).cast("int")
    repeated = joined.withColumn(src, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return repeated.select(*[docs[c] for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, size, source) - 1 AS nth FROM d
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM t
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS bound FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER f - cap)) / (sum(weight) OVER () - (sum(weight) OVER f - weight)) AS level_here
  FROM c WINDOW f AS (ORDER BY bound, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), v AS (
  SELECT *, max(CASE WHEN level_here <= bound THEN level_here END) OVER () AS level FROM l
), r AS (
  SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM v
), x AS (
  SELECT n.doc_id, n.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(n.doc_id::VARCHAR, 'null') || ':' || n.size || ':' || n.nth), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM x
"""
