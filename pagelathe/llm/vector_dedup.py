"""Near-duplicate vectors by random-hyperplane sign hashing, confirmed by exact cosine.

1. Equal vectors of one label become one class with a count.
2. In each table a class gets the signs of its projections on `bits` random hyperplanes. The number of
   bits follows the largest label (about half a block of classes a bucket: comparing within a block is cheap,
   each further table ships vectors), the number of tables the bits, so that a pair at the threshold is
   missed by all tables with probability MISS at most.
3. Classes of one label, dimension, table and code are a bucket; these are its real keys, no hash of them.
   Buckets with the same members in several tables are compared once. All pairs of a bucket are compared
   in double precision. A bucket larger than BLOCK is dealt out as pairs of blocks, so nothing is capped
   and no task holds more than two blocks.
4. Classes carry the codes of all tables along. A pair counts in the first table where its codes agree, so
   links are counted without listing pairs; tasks emit sums and a spanning star. Components are found
   distributed.
5. Joins on vectors, codes, buckets and results are merged, never broadcast: Spark judges a table by its
   compressed file and an exploded list as one row, so a side beyond the driver's memory would pass for small.
   The first numbers of ranges (`gapless`) may be broadcast, by their measured size.

Pairs are not listed, as a bucket of n copies with small differences has n * n of them; so vectors travel to
their buckets, with their codes, and no code is computed twice.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors
without label and rows without id link with nothing: n_links 0, a component of their own. Vectors of
different length never link. Rows that repeat an id are vectors of their own. Empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelathe.llm.components import components
from pagelathe.llm.minhash import star
from pagelathe.llm.numbering import gapless
from pagelathe.runtime import materialize, release, ship_package

THRESHOLD = 0.93
MISS = 2e-4
PER_BUCKET = 128
BLOCK = 256
MOST_BITS = 30
#: A vector's row counts as so many narrow ones.
VALUES = 16


def parameters(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for the largest label's number of classes."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(2, largest / PER_BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(MISS) / math.log(1 - agree)))


def _codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype("<i4")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square overflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _hash(bits: int, tables: int):
    """Rows (cid, v, dim, ...) with the codes of all tables, as bytes and as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                codes = _codes(_matrix(part.column(1), dim), bits, tables)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * tables), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, raw, listed], [*part.schema.names, "packed", "codes"])

    return run


def _compare(tables: int, threshold: float):
    """Rows (task, table, dim, side, cid, copies, packed, v) sorted by task to (a, null, sum of links) and links (a, b, 0)."""

    def links(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        none = np.zeros(0, np.int64)
        table, dim = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        side, ids, weight = (rows.column(i).to_numpy() for i in (3, 4, 5))
        unit = _matrix(rows.column(7), dim)
        near = unit @ unit.T >= threshold
        near &= side[:, None] != side[None, :] if side.max() > 0 else ~np.eye(len(ids), dtype=bool)
        a, b = np.nonzero(near)
        if table and len(a):
            codes = np.frombuffer(b"".join(rows.column(6).to_pylist()), "<i4").reshape(-1, tables)
            fresh = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
        if not len(a):
            return none, none, none, []
        linked = np.zeros_like(near)
        linked[a, b] = True
        got = np.bincount(a, weights=weight[b], minlength=len(ids)).astype(np.int64)
        some = np.flatnonzero(got)
        return ids[some], got[some], none, star(ids, linked)

    def made(found: list[tuple]) -> pa.RecordBatch:
        ids = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        sums = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        edges = [e for f in found for e in f[3]]
        a = pa.array([*ids.tolist(), *(e[0] for e in edges)], pa.int64())
        b = pa.array([*[None] * len(ids), *(e[1] for e in edges)], pa.int64())
        return pa.RecordBatch.from_arrays([a, b, pa.array([*sums.tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the task that the last batch ended in
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(tasks)) if tasks[i] != tasks[i - 1]), len(tasks)]
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tasks[x] != last:
                    found.append(_whole(held))
                    held = []
                last = tasks[x]
                held.append(batch.slice(x, y - x))
            yield made([links(r) for r in found if r.num_rows > 1])
        if held:
            yield made([links(r) for r in [_whole(held)] if r.num_rows > 1])

    return run


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def assign(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `table`: id, n_links, component_id, kept."""
    ship_package(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("sound", sound), "vectors")
    n = rows.count()
    good = rows.where("sound")
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vector-classes", n * VALUES)
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits, tables = parameters(largest, threshold)
    coded = classes.select("cid", "v", "dim", "label", "copies")
    full = materialize(coded.mapInArrow(_hash(bits, tables), StructType([*coded.schema, *StructType.fromDDL("packed binary, codes array<int>")])), "coded-vectors", n * VALUES)
    # What tells buckets apart, in one text: numbers first, then the label as it is.
    key = F.concat_ws("|", "dim", "table", "code", F.col("label").cast("string")).alias("bucket")
    spots = full.select("cid", "label", "dim", F.posexplode("codes").alias("table", "code")).select(key, "table", "cid")
    spots = materialize(spots, "buckets", n * tables)
    sizes = spots.groupBy(F.col("bucket").alias("of_bucket")).agg(F.count(F.lit(1)).alias("m"), F.min("table").alias("of_table"), F.min("cid").alias("low"), F.bit_xor(F.xxhash64("cid")).alias("who")).where("m > 1")
    # Of buckets with the same members the one of the first table is compared, as pairs count there.
    first = sizes.groupBy("m", "low", "who").agg(F.min_by("of_bucket", F.struct("of_table", "of_bucket")).alias("of_bucket")).select("of_bucket", "m")
    first = materialize(first, "bucket-sizes", n * tables)
    members = materialize(spots.join(first.hint("merge"), F.col("bucket") == F.col("of_bucket")).select("bucket", "m", "cid", "table"), "bucket-members", n * tables)
    release(spots, first)
    tasks = members.where(f"m <= {BLOCK}").select(F.col("bucket").alias("task"), "table", F.lit(0).alias("side"), F.col("cid").alias("of_cid"))
    large = members.where(f"m > {BLOCK}")
    if not large.isEmpty():
        placed = gapless(large, ["bucket"], ["cid"], "nth").withColumn("block", F.floor(F.col("nth") / BLOCK)).withColumn("last", F.floor((F.col("m") - 1) / BLOCK))
        # Block b meets itself, later blocks from the left and earlier ones from the right.
        placed = placed.select("bucket", "table", "cid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
        pair = F.concat_ws("|", F.least("block", "other"), F.greatest("block", "other"), "bucket")
        tasks = tasks.unionByName(placed.select(pair.alias("task"), "table", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), F.col("cid").alias("of_cid")))
    shipped = full.join(tasks.hint("merge"), F.col("cid") == F.col("of_cid")).select("task", "table", "dim", "side", "cid", "copies", "packed", "v")
    dealt = shipped.repartition("task").sortWithinPartitions("task")
    found = materialize(dealt.mapInArrow(_compare(tables, threshold), "a long, b long, w long"), "vector-links")
    release(members, full)
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("w"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("cid", "rep", "copies").join(parts.hint("merge"), F.col("cid") == F.col("node"), "left").join(sums.hint("merge"), "cid", "left")
    named = named.select("cid", "rep", F.coalesce("component", "cid").alias("component"), (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    named = materialize(named, "named", n)
    # Written first: a join with an aggregate in the same stage could not be split for a large component.
    low = materialize(named.groupBy(F.col("component").alias("of_component")).agg(F.min("rep").alias("component_id")), "component-ids", n)
    named = named.join(low.hint("merge"), F.col("component") == F.col("of_component")).select(F.col("cid").alias("of_cid"), "n_links", "component_id")
    known = classes.select("cid", F.col("label").alias("of_label"), F.col("v").alias("of_v")).join(named.hint("merge"), F.col("cid") == F.col("of_cid")).select("of_label", "of_v", "n_links", "component_id")
    out = good.join(known.hint("merge"), (F.col("label") == F.col("of_label")) & (F.col("v") == F.col("of_v"))).select("id", "n_links", "component_id")
    rest = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = out.unionByName(rest).withColumnRenamed("id", id_col)
    return both.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION
  SELECT p.b, r.c FROM r JOIN p ON p.a = r.a
), m AS (
  SELECT a, min(c) AS c FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS k FROM p GROUP BY a
)
SELECT m.a AS vec_id, coalesce(n.k, 0)::BIGINT AS n_links, m.c AS component_id, m.a = m.c AS kept
FROM m LEFT JOIN n ON n.a = m.a
"""
