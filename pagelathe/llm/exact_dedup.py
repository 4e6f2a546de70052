"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive runs of bytes. A round groups the documents still in doubt by
(group, next run of bytes). A group of one is settled: no other text equals it. A group whose run
was shorter than asked for has ended: its texts are equal, byte by byte, and no digest takes part
in the decision. Every other group goes to the next round with the rest of its bytes. Runs grow
eightfold, so the number of rounds is the logarithm of the longest repeated text.

Scale: only a short prefix of unique documents is grouped; whole texts travel once, and from there
on only those that share their beginning with another. Counts are combined on the map side, so a
group of any size becomes one row a task. Rows find their group by a plain equi-join, whose
oversized partitions adaptive execution splits.

Defined results: a null text counts as empty. Null ids are the smallest. Of rows with equal text and
equal id just one stays. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.runtime import materialize

FIRST_RUN = 64
GROWTH = 8
LONGEST_RUN = 1 << 20

_ROW = "id long, digest string, grp long, size long, best long"


def _settle(rows: DataFrame, keys: list[str], run: int, number: int, bound: int | None) -> DataFrame:
    """One round: `rows` (id, digest, rest, keys) become settled rows and rows with a shorter rest.

    The last key is the run of bytes; `bound` is one of the number of rows. Output: id, digest, grp, size, best, rest (null when settled).
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("best"))
    # Frozen, as the new group's number must be the same for all tasks that read it.
    groups = materialize(
        groups.where("size > 1").withColumn("grp", F.monotonically_increasing_id()).select(*[F.col(k).alias(f"k_{k}") for k in keys], "grp", "size", "best"),
        f"radix-groups-{number}",
        bound,
    )
    same = reduce(lambda a, b: a & b, [rows[k] == groups[f"k_{k}"] for k in keys])
    # The groups have no bound, so they are shuffled at any size.
    on = rows.join(groups.hint("merge"), same, "left")
    ended = F.octet_length(rows[keys[-1]]) < run
    rest = F.when(groups["grp"].isNotNull() & ~ended, F.expr(f"substring(rest, {run + 1})"))
    return on.select(rows["id"], rows["digest"], groups["grp"], F.coalesce(groups["size"], F.lit(1)).alias("size"), groups["best"], rest.alias("rest"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """For each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id among the rows whose text equals this row's; `kept` marks that row.
    `normalise` replaces the text column's value before comparison; by default texts are compared as
    they are. The digest is reported, never compared.
    """
    text = F.encode(F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("rest"))
    rows = rows.select("id", "rest", F.sha2("rest", 256).alias("digest"), F.expr(f"substring(rest, 1, {FIRST_RUN})").alias("part"))
    done: list[DataFrame] = []
    run, number, keys, bound = FIRST_RUN, 0, ["part"], None
    while True:
        out = materialize(_settle(rows, keys, run, number, bound), f"radix-{number}")
        done.append(out.where("rest IS NULL").drop("rest").withColumn("round", F.lit(number)))
        left = out.where("rest IS NOT NULL")
        bound = left.count()
        if not bound:
            break
        run, number, keys = min(run * GROWTH, LONGEST_RUN), number + 1, ["prior", "part"]
        rows = left.select("id", "digest", "rest", F.col("grp").alias("prior"), F.expr(f"substring(rest, 1, {run})").alias("part"))
    settled = reduce(DataFrame.unionByName, done)
    alone = settled.where("grp IS NULL").select("id", F.col("id").alias("keep_id"), "size", F.lit(True).alias("kept"), "digest")
    # Equal ids within a group: one of them stays, by the number of the row in the frozen tables.
    copies = settled.where("grp IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    copies = materialize(copies, "radix-copies")
    winners = copies.where("id <=> best").groupBy("round", "grp").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("won"))
    copies = copies.join(winners, "row", "left").select("id", F.col("best").alias("keep_id"), "size", F.coalesce("won", F.lit(False)).alias("kept"), "digest")
    both = alone.unionByName(copies)
    return both.select(F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `assign` does not keep; all columns stay as they are.

    Rows are found again by id and digest of the text; rows that share both are repeats of one
    document, of which one is returned.
    """
    stay = assign(docs, id_col, text_col).groupBy(id_col, "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("repeats")).where("stays")
    stay = stay.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_digest"), "repeats")
    marked = docs.withColumn("_sha", F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))
    found = marked.join(stay, marked[id_col].cast("long").eqNullSafe(stay["_id"]) & (marked["_sha"] == stay["_digest"]))
    once = found.where("repeats = 1").select(*[marked[c] for c in docs.columns])
    more = found.where("repeats > 1").dropDuplicates(["_id", "_digest"]).select(*[F.col(c) for c in docs.columns])
    return once.unionByName(more)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
