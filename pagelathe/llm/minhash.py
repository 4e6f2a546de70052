"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

1. One pass makes each document's set of word shingles, a digest of the set and its signature.
   Documents with equal sets become one class, whose smallest id stands for it.
2. Each tree of the forest has its own order of signature values, by which the classes lie sorted. Classes
   that agree on a tree's first values are a region of it: those whose longest common prefix is at
   least so long. A region's depth follows the crowd in it. It begins at `depth - 1` values; where more
   than ROOM classes agree on these, the region is parted by its next value. A pair at the threshold
   agrees on `depth` values of some tree but for MISS, and on fewer more often, so sparse regions are
   searched beyond what the bound needs. Regions with the same members in several trees are kept once.
3. A region of up to BLOCK classes is compared whole. A larger one is refined further: sorted by its
   deeper signature values, so that neighbours have the longest common prefixes, and cut into blocks of
   BLOCK, each compared whole.
4. The exact way for the rest: where a large region still has several components, its members outside
   the most frequent component are sorted by the size of their sets, as are all members; blocks of both
   are compared where sizes allow a link at all, but for pairs that are already connected. So every two
   classes that share a region are compared or connected.
5. Links are confirmed on the full sets. Tasks emit only a spanning star of what they link.

Scale: the signature table is narrow; whole texts are read twice and shuffled once, for the join with
the regions' members. A task holds two blocks of sets at most. Groups of copies are one class before
any comparison; members of a hot region are dealt out by block.

Defined results: texts without words (or null) have no shingles and link with nothing. Rows that share
an id are one node that has the links of each of its rows. A null id links with nothing and has a null
component. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.components import components
from pagelathe.llm.numbering import gapless
from pagelathe.llm.shingles import minima, mix, shingle_sets
from pagelathe.runtime import materialize, release, ship_package

TREES = 16
#: Classes in a region beyond which it is parted by the next value.
ROOM = 24
BLOCK = 128
DEEPER = 2
#: Most that a pair at the threshold may be missed by all trees.
MISS = 3e-4


def depth_for(percent: int, trees: int = TREES) -> int:
    """The deepest prefix at which a pair of the threshold's similarity is missed by less than MISS."""
    s, depth = percent / 100, 1
    while depth < 8 and (1 - s ** (depth + 1)) ** trees <= MISS:
        depth += 1
    return depth


def _signatures(size: int, depth: int):
    """Per document and tree: hashes of the first depth - 1 and depth values, and the values after those as a number."""
    count = TREES * depth
    rng = np.random.default_rng(17)
    orders = [[*range(t * depth, (t + 1) * depth), *rng.permutation([j for j in range(count) if j // depth != t])[:DEEPER]] for t in range(TREES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = list(shingle_sets(part.column(1), size))
                full = [s for s in sets if len(s)]
                keys = iter(())
                if full:
                    sig = minima(full, count).astype(np.uint64)
                    trees = np.empty((len(full), TREES, 3), np.int64)
                    for t, order in enumerate(orders):
                        key = np.full(len(full), t, np.uint64)
                        for j in order[:depth]:
                            trees[:, t, 0] = key.view(np.int64)  # at last that of depth - 1
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                        trees[:, t, 1] = key.view(np.int64)
                        trees[:, t, 2] = (sig[:, order[depth]] >> np.uint64(1) << np.uint64(32) | sig[:, order[depth + 1]]).view(np.int64)
                    keys = iter(trees.reshape(len(full), -1).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.sha256(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "digest", "keys"],
                )

    return run


def common_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    m = len(sets)
    joined = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    if not len(joined):
        return np.zeros((m, m))
    column = np.cumsum(np.concatenate(([0], joined[1:] != joined[:-1])))
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((m, m))
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            here = np.zeros((m, int(column[b - 1]) - k * width + 1), np.float32)
            here[owner[a:b], column[a:b] - k * width] = 1
            out += here @ here.T
    return out


def star(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each of `ids` to the smallest of its component under the boolean matrix `linked`."""
    label = ids.copy()
    rows, cols = np.nonzero(linked)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        before = label.copy()
        np.minimum.at(label, rows, low)
        np.minimum.at(label, cols, low)
        if (label == before).all():
            break
    return [(int(i), int(j)) for i, j in zip(ids, label, strict=True) if i != j]


def _compare(size: int, percent: int):
    """Rows (task, side, id, comp, text) sorted by task; side 0 meets side 0 and 1, side 1 only 0 (None: all meet all)."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = list(shingle_sets(pa.array([r[3] for r in rows], pa.string()), size))
        counts = common_counts(sets)
        length = np.array([len(s) for s in sets], float)
        union = length[:, None] + length[None, :] - counts
        linked = (100 * counts >= percent * union) & (counts > 0)
        side = np.array([r[0] for r in rows])
        linked &= (side[:, None] == 0) | (side[None, :] == 0)
        return star(np.array([r[1] for r in rows], np.int64), linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for t, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if t != task:
                    found += links(rows) if len(rows) > 1 else []
                    task, rows = t, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        found = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def _confirmed(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among `members` (task, side, id, comp)."""
    # Members have no bound, so the texts are shuffled at any size.
    rows = texts.join(members.hint("merge"), "id").select("task", "side", "id", "comp", "text")
    dealt = rows.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_compare(size, percent), "a long, b long")


def resolve(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components, as (node, component), of the confirmed links inside regions.

    `members`: frozen rows (region, m, id, n, deep), m the region's size, n that of the set and deep the
    order inside the region; `texts`: (id, text). Ids without a link may be absent.
    """
    none = F.lit(None).cast("long").alias("comp")
    small = members.where(f"m <= {BLOCK}").select(F.col("region").alias("task"), F.lit(0).alias("side"), "id", none)
    large = members.where(f"m > {BLOCK}")
    hot = not large.isEmpty()
    if hot:
        placed = gapless(large, ["region"], ["deep", "id"], "nth")
        placed = materialize(placed.select("region", "id", "n", F.floor(F.col("nth") / BLOCK).alias("block")), "blocks")
        small = small.unionByName(placed.select(F.xxhash64("region", "block").alias("task"), F.lit(0).alias("side"), "id", none))
    linked = materialize(_confirmed(small, texts, size, percent), "links")
    found = components(linked)
    if hot:
        n = members.count()  # a bound of what follows, but for the pairs of blocks
        found = materialize(found, "components", n)
        comps = placed.join(found, placed["id"] == found["node"], "left").select("region", "id", "n", F.coalesce("component", "id").alias("comp"))
        comps = materialize(comps, "block-components", n)
        sizes = comps.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = sizes.groupBy(F.col("region").alias("of_region")).agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        apart = materialize(comps.join(main, F.col("region") == F.col("of_region")).select("region", "id", "n", "comp", (F.col("comp") != F.col("main")).alias("rest")), "apart", n)
        release(placed, comps)
        if not apart.isEmpty():
            dealt = []
            for side, rows in ((0, apart.where("rest")), (1, apart)):
                rows = gapless(rows, ["region"], ["n", "id"], "nth").select("region", "id", "n", "comp", F.floor(F.col("nth") / BLOCK).alias("block"))
                dealt.append(materialize(rows, f"sized-{side}", n))
            low, high = (d.groupBy("region", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")).toDF("region", *[f"{c}_{side}" for c in ("block", "least", "most")]) for side, d in enumerate(dealt))
            # Sets link only if the smaller has PERCENT of the larger's size at least.
            meet = low.join(high, "region").where((100 * F.col("most_1") >= percent * F.col("least_0")) & (100 * F.col("most_0") >= percent * F.col("least_1")))
            meet = materialize(meet.select("region", "block_0", "block_1"), "block-pairs")
            both = []
            for side, rows in enumerate(dealt):
                named = rows.select(F.col("region").alias("of_region"), F.col("block").alias("of_block"), "id", "comp")
                named = named.join(meet, (F.col("of_region") == F.col("region")) & (F.col("of_block") == F.col(f"block_{side}")))
                both.append(named.select(F.xxhash64("region", "block_0", "block_1", F.lit(1)).alias("task"), F.lit(side).alias("side"), "id", "comp"))
            more = materialize(_confirmed(both[0].unionByName(both[1]), texts, size, percent), "more-links")
            release(*dealt, meet)
            if not more.isEmpty():
                found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        release(apart)
    return found


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship_package(spark)
    depth = depth_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = materialize(texts.mapInArrow(_signatures(size, depth), "id long, n long, digest binary, keys array<long>"), "signatures")
    least = made.where("digest IS NOT NULL AND id IS NOT NULL").groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("rep"))
    n = made.count()
    least = materialize(least, "least", n)  # apart from the join, which can then be split for a hot digest
    mapped = materialize(made.join(least, F.col("digest") == F.col("of"), "left").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys"), F.xxhash64("digest").alias("mark")), "classes", n * TREES)
    release(made, least)

    heads = mapped.where("keys IS NOT NULL").groupBy("rep", "mark").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(*[F.get("keys", t * 3 + k).alias(c) for k, c in enumerate(("short", "long", "deep"))]))
    spots = materialize(heads.select("rep", "mark", "n", F.explode(trees).alias("s")).select("rep", "mark", "n", "s.*"), "forest", n * TREES)
    who = [F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep", "mark")).alias("who")]

    def once(regions: DataFrame) -> DataFrame:
        """Regions that several trees found with the same members are kept once."""
        return regions.groupBy("m", "low", "who").agg(F.min("region").alias("of_region")).select("of_region", "m")

    shorts = materialize(spots.groupBy(F.col("short").alias("region")).agg(F.count(F.lit(1)).alias("m"), *who).where("m > 1"), "short-regions", n * TREES)
    # Crowded regions are parted by their next value.
    wide = once(shorts.where(f"m <= {ROOM}")).unionByName(shorts.where(f"m > {ROOM}").select(F.col("region").alias("of_region"), "m"))
    near = materialize(spots.join(wide.hint("merge"), F.col("short") == F.col("of_region")).select("rep", "mark", "n", "short", "long", "deep", "m"), "neighbours", n * TREES)
    release(spots, shorts)
    crowded = near.where(f"m > {ROOM}").drop("m")
    longs = once(crowded.groupBy(F.col("long").alias("region")).agg(F.count(F.lit(1)).alias("m"), *who).where("m > 1"))
    longs = materialize(longs, "long-regions", n * TREES)
    members = near.where(f"m <= {ROOM}").select(F.col("short").alias("region"), "m", F.col("rep").alias("id"), "n", "deep")
    members = members.unionByName(crowded.join(longs.hint("merge"), F.col("long") == F.col("of_region")).select(F.col("long").alias("region"), "m", F.col("rep").alias("id"), "n", "deep"))
    members = materialize(members, "members", n * TREES)
    release(near, longs)

    # Whole texts travel once; the rounds of comparison then read those of candidates alone.
    wanted = members.select("id").distinct()
    candidates = materialize(texts.join(wanted.hint("merge"), "id", "left_semi"), "candidate-texts")
    found = materialize(resolve(members, candidates, size, percent), "linked", n)
    release(members, candidates)
    # The classes of an id's rows are one node.
    nodes = mapped.where("id IS NOT NULL").select("id", F.coalesce("rep", "id").alias("rep"))
    several = nodes.groupBy(F.col("id").alias("of_id")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    ties = materialize(nodes.where("id <> rep").join(several, F.col("id") == F.col("of_id"), "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")), "ties", n)
    if not ties.isEmpty():
        found = components(materialize(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties), "tied", n))
    out = mapped.join(found, F.coalesce(mapped["rep"], mapped["id"]) == found["node"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; columns as they are."""
    gone = assign(docs, id_col, text_col, size, percent).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND x.n * 100 >= 85 * y.n AND y.n * 100 >= 85 * x.n
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents
  UNION
  SELECT p.b, r.c FROM r JOIN p ON p.a = r.a
), m AS (
  SELECT a, min(c) AS c FROM r GROUP BY a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN m ON s.doc_id = m.a
"""
