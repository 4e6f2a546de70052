"""Repeated passages across documents: paragraph MinHash banding, exact Jaccard, components.

1. A passage need not begin or end with a line, so every run of PARAGRAPH words of a document is a paragraph.
   Its MinHash is the least hash of its runs of SEED words; neighbours mostly share it, so a document
   keeps each minimum once, with its place (`marks`; about one for seven words).
2. Bands are tuned for recall: one band of one row, as a paragraph must not be missed. Equal
   paragraphs always collide. Near copies of 0.8 on five-word shingles do, too: every change of a word costs
   nine shingles of the union, so two passages of PASSAGE_WORDS words or more that alike have 20 equal words
   in a row, which is a paragraph.
3. Paragraphs that collide are joined: of each minimum the document with the smallest id is the keeper, and
   every other document that holds it is compared with the keeper. So a minimum that n documents hold
   makes n - 1 pairs. Collisions of two documents at about the same distance are one stretch.
4. Stretches are verified on the words themselves: all common five-word runs are followed word by word to
   their ends, and runs are joined while the exact Jaccard of the joined stretches is PERCENT or more
   (`aligned`). Only verified stretches of PARAGRAPH words or more count.
5. In each document, verified stretches that touch are one passage, those that an earlier document holds
   (`removed`) apart from those that it keeps for later ones. Passages are clustered by the verified
   links between them, as connected components.

So each word of a removed passage stands in a verified stretch of an earlier document, and every run of
PARAGRAPH words that an earlier document holds is in a stretch. A near copy is compared with the earliest
document of each minimum that they share, not with all.

Scale: one narrow row a minimum is shuffled, with counts combined on the map side, so a passage that a third of
all documents hold is one row a task. Only rows of repeated minima go on. Of texts only the verified
stretches travel, the keeper's once for all its copies. Joins are between written tables, so adaptive
execution can split hot keys. What a step has written is deleted when the next one has read it.

Defined results: null or empty texts have no passages; rows with a null id are left out, as nothing
could name them; rows that repeat an id are one document, and what repeats only inside a document does
not count. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.components import components
from pagelathe.llm.shingles import ngrams, pieces, words
from pagelathe.runtime import materialize, release, ship_package

#: Words of a paragraph, and of the runs whose hashes its MinHash is the least of.
PARAGRAPH, SEED = 20, 8
PASSAGE_WORDS = 30
SIZE, PERCENT = 5, 80
#: Words before and after a paragraph's minimum that are looked at; the paragraph's own are among them.
BEFORE, AFTER = 40, 60
#: Words between seeds, and shifts between them, over which texts are aligned; words of a run that may shift them further.
FAR, SURE = 48, 16

_MARKS = "id long, row int, key long, first int, lo int, hi int"
_MARK_TYPES = {"id": pa.int64(), "row": pa.int32(), "key": pa.int64(), "first": pa.int32(), "lo": pa.int32(), "hi": pa.int32()}


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of every `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def marks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which the least run of some paragraph begins, and the runs' hashes.

    `first` has the first word of each document, with the total last; no paragraph crosses a document's
    end. Of equal minima in a row (repeated words) one for PARAGRAPH words is kept.
    """
    grams = ngrams(hashes, SEED)
    width = PARAGRAPH - SEED + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(grams, width, np.minimum)
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    least[np.arange(len(least)) + PARAGRAPH > ends] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
    if not len(at):
        return at, grams[at]
    doc = np.searchsorted(first, at, "right")
    fresh = np.ones(len(at), bool)
    fresh[1:] = (grams[at[1:]] != grams[at[:-1]]) | (doc[1:] != doc[:-1]) | (np.diff(at) > PARAGRAPH)
    nth = (at - at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]) // PARAGRAPH
    fresh[1:] |= nth[1:] != nth[:-1]
    at = at[fresh]
    return at, grams[at]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row0, data, bounds in pieces(batch.column(2)):
            hashes, starts, ends, first = words(data, bounds)
            sizes = np.diff(first)
            own = batch.slice(row0, len(sizes))
            at, keys = marks(hashes, first)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            told = own.column(0).is_valid().to_numpy(zero_copy_only=False) & (sizes >= PASSAGE_WORDS)
            at, keys, doc = at[told[doc]], keys[told[doc]], doc[told[doc]]
            lo = starts[np.maximum(at - BEFORE, first[doc])] - bounds[doc]
            hi = ends[np.minimum(at + AFTER, first[doc + 1]) - 1] - bounds[doc]
            d = pa.array(doc)
            cols = [own.column(0).take(d), own.column(1).take(d), keys.view(np.int64), at - first[doc], lo, hi]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, _MARK_TYPES.values(), strict=True)], list(_MARK_TYPES))


def _runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(first in a, first in b, words) of runs of SIZE equal words or more, in the order of `a`.

    A run goes on along its shift as far as words are equal; short ones that shift by more than FAR are left out.
    """
    ga, gb = ngrams(a, SIZE), ngrams(b, SIZE)
    out: list[tuple[int, int, int]] = []
    if not len(ga) or not len(gb):
        return out
    values, where = np.unique(gb, return_index=True)
    at = np.minimum(np.searchsorted(values, ga), len(values) - 1)
    hits = np.flatnonzero(values[at] == ga)
    place = where[at]
    k, shift = 0, None
    while k < len(hits):
        i = int(hits[k])
        j = int(place[i])
        if shift is not None and 0 <= i + shift < len(gb) and gb[i + shift] == ga[i]:
            j = i + shift
        n, step = 1, 64
        while step:
            m = min(step, len(ga) - i - n, len(gb) - j - n)
            same = ga[i + n : i + n + m] == gb[j + n : j + n + m]
            good = m if same.all() else int(np.argmin(same))
            n += good
            step = step * 2 if m and good == m else 0
        if shift is None or abs(j - i - shift) <= FAR or n + SIZE - 1 >= SURE:
            out.append((i, j, n + SIZE - 1))
            shift = j - i
        k = int(np.searchsorted(hits, i + n))
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first in a, end in a, first in b, end in b) of stretches of word hashes with exact Jaccard of PERCENT or more.

    Runs of equal words are joined over at most FAR words; where the joined stretches are less alike
    than that, they are parted at the widest gap.
    """
    runs = np.array(_runs(a, b), np.int64).reshape(-1, 3)
    if not len(runs):
        return []
    ga, gb = ngrams(a, SIZE), ngrams(b, SIZE)
    a0, b0, n = runs.T
    gaps = np.maximum(a0[1:] - (a0 + n)[:-1], np.abs((b0 - a0)[1:] - (b0 - a0)[:-1]))
    shared = np.concatenate(([0], np.cumsum(n - SIZE + 1)))
    cuts = [0, *(np.flatnonzero(gaps > FAR) + 1).tolist(), len(runs)]
    todo, out = list(zip(cuts[:-1], cuts[1:], strict=True)), []
    while todo:
        i, j = todo.pop()
        p, q, r, s = int(a0[i]), int((a0 + n)[i:j].max()), int(b0[i:j].min()), int((b0 + n)[i:j].max())
        if j - i > 1:
            both, all_ = int(shared[j] - shared[i]), q - p + s - r - 2 * (SIZE - 1)
            fits = 100 * both >= PERCENT * (all_ - both)  # quick; the sets decide
            if fits:
                one, two = np.unique(ga[p : q - SIZE + 1]), np.unique(gb[r : s - SIZE + 1])
                both = len(np.intersect1d(one, two, assume_unique=True))
                fits = 100 * both >= PERCENT * (len(one) + len(two) - both)
            if not fits:
                cut = i + 1 + int(np.argmax(gaps[i : j - 1]))
                todo += [(i, cut), (cut, j)]
                continue
        out.append((p, q, r, s))
    return out


_SIDE = ("id", "row", "first", "last", "start", "stop")
_FOUND = [*_SIDE, *(f"k_{c}" for c in _SIDE)]
_FOUND_TYPES = {c: pa.int64() if c.endswith("id") else pa.int32() for c in _FOUND}


def _cut_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    return words(data, np.array([0, len(data)]))[:3]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple = (None, None)
    for batch in batches:
        rows = []
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a = _cut_words(one["text"])
            if known[0] != two["text"]:  # the copies of one stretch lie together
                known = (two["text"], _cut_words(two["text"]))
            b = known[1]
            for p, q, r, s in aligned(a[0], b[0]):
                # Stretches without a minimum of this pair are verified by the pair that has one.
                if q - p >= PARAGRAPH and s - r >= PARAGRAPH and p + one["first"] <= one["last_mark"] and q + one["first"] > one["first_mark"]:
                    row: list[int] = []
                    for cut, (_, starts, ends), x, y in ((one, a, p, q), (two, b, r, s)):
                        row += [cut["id"], cut["row"], cut["first"] + x, cut["first"] + y, cut["base"] + int(starts[x]), cut["base"] + int(ends[y - 1])]
                    rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_FOUND_TYPES.values())], _FOUND)


def _pairs(hits: DataFrame) -> DataFrame:
    """Stretches to verify: of a document (id, row) and of the keeper (k_id, k_row), each by words and bytes."""
    own = hits.where("id = keep").groupBy(F.col("key").alias("of_key")).agg(F.min(F.struct("row", "first", "lo", "hi")).alias("own"))
    seeds = hits.where("id > keep").join(own, F.col("key") == F.col("of_key"))
    seeds = seeds.select("id", "row", "first", "lo", "hi", F.col("keep").alias("k_id"), F.col("own.row").alias("k_row"), F.col("own.first").alias("k_first"), F.col("own.lo").alias("k_lo"), F.col("own.hi").alias("k_hi"))
    sides = ["id", "row", "k_id", "k_row"]
    by_pair = Window.partitionBy(*sides).orderBy("first", "k_first")
    shift = F.col("k_first") - F.col("first")
    apart = (F.col("first") - F.lag("first").over(by_pair) > FAR + PARAGRAPH) | (F.abs(shift - F.lag(shift).over(by_pair)) > FAR)
    seeds = seeds.withColumn("fresh", F.coalesce(apart.cast("int"), F.lit(1)))
    seeds = seeds.withColumn("stretch", F.sum("fresh").over(by_pair.rowsBetween(Window.unboundedPreceding, 0)))
    return seeds.groupBy(*sides, "stretch").agg(
        F.min("first").alias("first_mark"), F.max("first").alias("last_mark"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("k_first").alias("k_first_mark"), F.min("k_lo").alias("k_lo"), F.max("k_hi").alias("k_hi"),
    ).drop("stretch")


def _stretches(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The verified stretches of `pairs`, by _FOUND."""
    first = lambda mark: F.greatest(F.col(mark) - BEFORE, F.lit(0)).alias("first")
    same = ["k_id", "k_row", "k_first_mark", "k_lo", "k_hi"]
    copies = pairs.select(F.col("id").alias("of_id"), F.col("row").alias("of_row"), F.col("lo").alias("base"), F.col("hi").alias("stop"), first("first_mark"), "first_mark", "last_mark", *same)
    keepers = pairs.select(*same).distinct()
    none = F.lit(None).cast("int")
    keepers = keepers.select(F.col("k_id").alias("of_id"), F.col("k_row").alias("of_row"), F.col("k_lo").alias("base"), F.col("k_hi").alias("stop"), first("k_first_mark"), none.alias("first_mark"), none.alias("last_mark"), *same)
    wanted = materialize(copies.unionByName(keepers), "wanted")
    cut = F.substring(F.col("text").cast("binary"), F.col("base") + 1, F.col("stop") - F.col("base")).alias("text")
    cuts = texts.join(wanted.hint("merge"), (F.col("id") == F.col("of_id")) & (F.col("row") == F.col("of_row"))).select("id", "row", "base", "first", "first_mark", "last_mark", *same, cut)
    cuts = materialize(cuts, "cuts")
    release(wanted)
    side = F.struct("id", "row", "base", "first", "first_mark", "last_mark", "text")
    two = cuts.where("first_mark IS NULL").select(*[F.col(c).alias(f"of_{c}") for c in same], side.alias("two"))
    meet = F.lit(True)
    for c in same:
        meet = meet & (F.col(c) == F.col(f"of_{c}"))
    both = cuts.where("first_mark IS NOT NULL").select(*same, side.alias("one")).join(two.hint("merge"), meet).select("one", "two")
    out = materialize(both.mapInArrow(_verified, ", ".join(f"{c} {'long' if c.endswith('id') else 'int'}" for c in _FOUND)), "stretches")
    release(cuts)
    return out


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages: id, start_byte, end_byte, n_words, component_id, removed.

    Bytes are those of the UTF-8 text. component_id is the smallest id of the passage's component, in which
    links are verified stretches. `removed`: an earlier document holds all of it.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("row"), F.col(text_col).alias("text"))
    marked = materialize(texts.mapInArrow(_marked, _MARKS), "marks")
    n = marked.count()
    keys = marked.groupBy("key").agg(F.min("id").alias("keep"), F.max("id").alias("high")).where("keep < high").select(F.col("key").alias("of_key"), "keep")
    keys = materialize(keys, "repeated-minima", n)
    hits = materialize(marked.join(keys.hint("merge"), F.col("key") == F.col("of_key")).drop("of_key"), "hits", n)
    release(marked, keys)
    pairs = materialize(_pairs(hits), "pairs", n)
    release(hits)
    found = _stretches(texts, pairs)
    release(pairs)

    # A span is the longest stretch that begins at a word; so a document's spans are no more than its words.
    spans = found.select(*_SIDE, F.col("k_id").alias("keep"), F.lit(True).alias("removed"))
    spans = spans.unionByName(found.select(*[F.col(f"k_{c}").alias(c) for c in _SIDE], F.col("k_id").alias("keep"), F.lit(False).alias("removed")))
    n = 2 * found.count()
    spans = spans.groupBy("id", "row", "removed", "first", "start").agg(F.max("last").alias("last"), F.max("stop").alias("stop"), F.min("keep").alias("keep"))
    by_doc = Window.partitionBy("id", "row", "removed").orderBy("first")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    islands = materialize(islands.withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh"), "islands", n)
    key = ["id", "row", "removed", "island"]
    told = islands.groupBy(*key).agg(F.min("start").alias("start_byte"), F.max("stop").alias("end_byte"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("keep").alias("keep"))
    told = told.withColumn("n_words", (F.col("last") - F.col("first")).cast("long")).where(f"n_words >= {PASSAGE_WORDS}")
    # What is removed is not kept: a kept passage needs PASSAGE_WORDS words beside the removed ones before and after it.
    around = Window.partitionBy("id", "row").orderBy("first", F.desc("removed"))
    gone = F.when(F.col("removed"), F.struct("first", "last"))
    told = told.withColumn("prior", F.max(gone).over(around.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.min(gone).over(around.rowsBetween(1, Window.unboundedFollowing)))
    # least and greatest pass over nulls
    prior = F.greatest(F.least(F.coalesce("prior.last", "first"), "last") - F.col("first"), F.lit(0))
    later = F.greatest(F.least(F.coalesce("next.last", "last"), "last") - F.coalesce("next.first", "last"), F.lit(0))
    told = told.where(F.col("removed") | (F.col("n_words") - prior - later >= PASSAGE_WORDS)).drop("prior", "next")
    told = materialize(told.withColumn("node", F.monotonically_increasing_id()), "passages", n)

    # Verified links between passages
    named = told.select(*key, "node").join(islands.select(*key, "first"), key).drop("island")
    named = materialize(named, "nodes", n)
    ends = lambda side, removed: named.where(F.col("removed") == removed).select(*[F.col(c).alias(f"of_{c}") for c in ("id", "row", "first")], F.col("node").alias(side))
    links = found.select("id", "row", "first", "k_id", "k_row", "k_first").distinct()
    links = materialize(links.join(ends("a", True), (F.col("id") == F.col("of_id")) & (F.col("row") == F.col("of_row")) & (F.col("first") == F.col("of_first"))).select("a", "k_id", "k_row", "k_first"), "half-links", n)
    links = links.join(ends("b", False), (F.col("k_id") == F.col("of_id")) & (F.col("k_row") == F.col("of_row")) & (F.col("k_first") == F.col("of_first"))).select("a", "b")
    parts = materialize(components(links), "passage-components", n)
    release(found, islands, named)
    out = told.join(parts, told["node"] == parts["node"], "left").select("id", "start_byte", "end_byte", "n_words", "removed", "keep", F.col("component").alias("part"))
    # A passage is kept for one that is removed; a removed one may take its parts from shorter passages.
    out = materialize(out.where("removed OR part IS NOT NULL"), "parts", n)
    low = out.where("part IS NOT NULL").groupBy(F.col("part").alias("of_part")).agg(F.min("id").alias("low"))
    low = materialize(low, "least-ids", n)
    out = out.join(low, F.col("part") == F.col("of_part"), "left")
    return out.select(F.col("id").alias(id_col), "start_byte", "end_byte", "n_words", F.coalesce("low", "keep").alias("component_id"), "removed")
