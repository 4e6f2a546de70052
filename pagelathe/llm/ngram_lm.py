"""Language-model scores by stupid backoff (Brants et al., 2007) over counts of the whole corpus.

A document is scored by the counts of all other documents: its own occurrences are taken off, else
each of its n-grams would have been seen. For a word v after u, S = c(uv) / c(u) where c(uv) > 0 and
ALPHA * c(v) / N elsewhere; a word that no other document holds counts as UNSEEN occurrences. For longer
orders the same rule goes on from the longest context. The score is the sum of log S.

Computed relationally, in packed rows. Each split of the input is exploded to its distinct n-grams with
their counts, cut by hash into parts; parts with the same number meet in one group and are summed,
which is the count table partitioned by hash; joined back to each split's n-grams, a part returns the
totals in the split's own order; splits meet their totals and sum log scores per document. Hashes
travel as differences of sorted values, about six bytes an n-gram, each once a split however often it occurs.

Scale: a split is 16 MB of text or, for large inputs, as much as the square root of the input asks for: the
parts of all splits are splits times parts rows, and none is then below some hundred bytes (at 100 TB a
split has some 200 MB). A part's group holds a share of all distinct n-grams, and the number of parts
follows the number of splits, so tasks stay level and an n-gram that is in every text is one entry a
split. Texts are shuffled once, to meet their totals.

Words are runs outside ASCII white space, A-Z lowered. N-grams do not cross documents. Defined results:
null or empty texts have 0 words and score 0; null ids pass through; rows that repeat an id are documents
of their own; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.shingles import ngrams, pieces, words
from pagelathe.runtime import materialize, ship_package

ORDER = 2
ALPHA = 0.4
UNSEEN = 0.5
#: Bytes of text in a split, and bytes of text that a split has for each part, at least.
GROUP_BYTES, PART_BYTES = 16 << 20, 425


def pack(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, each in as many bytes as it needs."""
    gaps = np.diff(values, prepend=np.uint64(0))
    size = np.ones(len(gaps), np.uint8)
    for k in range(1, 8):
        size += gaps >= np.uint64(1 << (8 * k))
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = np.arange(8) < size[:, None]
    return np.int64(len(gaps)).tobytes() + size.tobytes() + raw[used].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    size = np.frombuffer(blob, np.uint8, n, 8)
    raw = np.zeros((n, 8), np.uint8)
    raw[np.arange(8) < size[:, None]] = np.frombuffer(blob, np.uint8, offset=8 + n)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in one byte each, with the large ones apart."""
    big = np.flatnonzero(values >= 255)
    return np.int64(len(big)).tobytes() + big.astype(np.int64).tobytes() + values[big].astype(np.int64).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out = np.frombuffer(blob, np.uint8, offset=8 + 16 * n).astype(np.int64)
    out[np.frombuffer(blob, np.int64, n, 8)] = np.frombuffer(blob, np.int64, n, 8 + 8 * n)
    return out


def _runs(column: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first row, bounds in words, n-gram hashes of each order by first word) for runs of rows.

    An n-gram that would cross a document's end is there too; callers leave it out by the bounds.
    """
    for row, data, bounds in pieces(column):
        hashes, _, _, first = words(data, bounds)
        yield row, first, [hashes, *(ngrams(hashes, k) for k in range(2, order + 1))]


def _inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n runs of k words stay inside their document."""
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= ends


def _count(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[], [], [], [], []]
            for k in range(1, order + 1):
                values, counts = np.unique(np.concatenate([h[k - 1] for h in held]), return_counts=True)
                cuts = np.searchsorted(values, [np.uint64((p << 64) // parts) for p in range(parts)])
                for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(values)], strict=True)):
                    if b > a:
                        for col, x in zip(rows, (now, p, k, pack(values[a:b]), pack_counts(counts[a:b])), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["split", "part", "k", "grams", "counts"])

        for batch in batches:
            splits = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), len(splits)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if now is not None and splits[a] != now and held:
                    yield from told()
                    held = []
                now = int(splits[a])
                for _, first, grams in _runs(batch.column(1).slice(a, b - a), order):
                    held.append([g[_inside(first, k + 1, len(g))] for k, g in enumerate(grams)])
        if held:
            yield from told()

    return run


def _total(table: pa.Table) -> pa.Table:
    """All splits' rows of one part: their counts become totals, in each split's order."""
    out: list[list] = [[], [], [], [], []]
    orders = np.array(table.column("k").to_pylist())
    for k in np.unique(orders).tolist():
        rows = table.take(pa.array(np.flatnonzero(orders == k)))
        grams = [unpack(b) for b in rows.column("grams").to_pylist()]
        counts = np.concatenate([unpack_counts(b) for b in rows.column("counts").to_pylist()])
        values, where = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(where, counts, len(values)).astype(np.int64)[where]
        cuts = np.cumsum([0, *map(len, grams)])
        words_in = int(counts.sum()) if k == 1 else 0
        for i, (split, a, b) in enumerate(zip(rows.column("split").to_pylist(), cuts[:-1], cuts[1:], strict=True)):
            for col, x in zip(out, (split, table.column("part")[0].as_py(), k, pack_counts(totals[a:b]), words_in if i == 0 else 0), strict=True):
                col.append(x)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["split", "part", "k", "totals", "n"])


def _score(order: int, total: int):
    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        ids = texts.column("id")
        held = list(_runs(texts.column("text"), order))
        keys = [np.unique(np.concatenate([h[2][k][_inside(h[1], k + 1, len(h[2][k]))] for h in held])) if held else np.zeros(0, np.uint64) for k in range(order)]
        sums: list[np.ndarray] = [np.zeros(0, np.int64)] * order
        known = sorted(zip(rows.column("k").to_pylist(), rows.column("part").to_pylist(), rows.column("totals").to_pylist(), strict=True), key=lambda r: r[:2])
        for k in range(order):
            got = [unpack_counts(r[2]) for r in known if r[0] == k + 1]
            sums[k] = np.concatenate(got) if got else sums[k]
        n_words, seen, logs = (np.zeros(len(ids), t) for t in (np.int64, np.int64, np.float64))
        for row, first, grams in held:
            lengths = np.diff(first)
            n = len(grams[0])
            doc = np.repeat(np.arange(len(lengths)), lengths)
            others = []  # by order: counts in other documents of the n-gram that begins at each word
            for k in range(order):
                ok = np.flatnonzero(_inside(first, k + 1, len(grams[k])))
                count = np.zeros(n, np.int64)
                if len(ok):
                    at = np.searchsorted(keys[k], grams[k][ok])
                    pair = doc[ok].astype(np.int64) * len(keys[k]) + at
                    _, where, own = np.unique(pair, return_inverse=True, return_counts=True)
                    count[ok] = sums[k][at] - own[where]
                others.append(count)
            left = total - lengths[doc]
            value = np.maximum(others[0], UNSEEN) / np.maximum(left, 1)
            long = np.zeros(n, bool)
            at = np.arange(n) - first[:-1][doc] if n else np.zeros(0, np.int64)  # place in the document
            for k in range(1, order):
                has = at >= k  # words with k words before them
                ends = np.flatnonzero(has)
                here = others[k][ends - k]
                before = others[k - 1][ends - k]
                value[ends] = np.where(here > 0, here / np.maximum(before, 1), ALPHA * value[ends])
                long[ends] = here > 0
            spot = slice(row, row + len(lengths))
            n_words[spot] = lengths
            seen[spot] = np.bincount(doc, long, len(lengths)).astype(np.int64)
            logs[spot] = np.bincount(doc, np.log(value), len(lengths))
        return pa.table([ids.cast(pa.int64()), pa.array(n_words), pa.array(seen), pa.array(logs)], names=["id", "n_words", "n_seen", "log_score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_seen (longest n-grams that others hold), log_score, mean_log_score."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits = max(1, -(-size // max(GROUP_BYTES, math.isqrt(size * PART_BYTES))))
    split = F.pmod(F.xxhash64("id", "text"), F.lit(splits)).cast("long").alias("split")
    # One exchange serves both passes: rows of a split lie together.
    dealt = rows.select(split, "id", "text").repartition(splits, "split")
    counted = dealt.select("split", "text").sortWithinPartitions("split").mapInArrow(_count(order, splits), "split long, part int, k int, grams binary, counts binary")
    totals = materialize(counted.groupBy("part").applyInArrow(_total, "split long, part int, k int, totals binary, n long"), "ngram-totals")
    corpus = totals.agg(F.sum("n")).first()[0] or 0
    out = dealt.groupBy("split").cogroup(totals.groupBy("split")).applyInArrow(_score(order, corpus), "id long, n_words long, n_seen long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", "n_seen", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), t AS (
  SELECT doc_id, len(ws) AS n, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i, unnest(list_prepend(NULL, ws[:-2])) AS u FROM w WHERE len(ws) > 0
), c1 AS (SELECT v, count(*) AS c FROM t GROUP BY 1),
d1 AS (SELECT doc_id, v, count(*) AS c FROM t GROUP BY 1, 2),
c2 AS (SELECT u, v, count(*) AS c FROM t WHERE i > 1 GROUP BY 1, 2),
d2 AS (SELECT doc_id, u, v, count(*) AS c FROM t WHERE i > 1 GROUP BY 1, 2, 3),
x AS (
  SELECT t.doc_id, t.i, (SELECT count(*) FROM t) - t.n AS rest,
         cv.c - dv.c AS own_v, cu.c - du.c AS own_u, coalesce(cb.c - db.c, 0) AS own_b
  FROM t JOIN c1 cv ON cv.v = t.v JOIN d1 dv ON dv.doc_id = t.doc_id AND dv.v = t.v
  LEFT JOIN c1 cu ON cu.v = t.u LEFT JOIN d1 du ON du.doc_id = t.doc_id AND du.v = t.u
  LEFT JOIN c2 cb ON t.i > 1 AND cb.u = t.u AND cb.v = t.v LEFT JOIN d2 db ON t.i > 1 AND db.doc_id = t.doc_id AND db.u = t.u AND db.v = t.v
), s AS (
  SELECT doc_id, count(*) AS n_words, sum((own_b > 0)::INT)::BIGINT AS n_seen,
         sum(ln(CASE WHEN own_b > 0 THEN own_b / greatest(own_u, 1)::DOUBLE
                     ELSE (CASE WHEN i > 1 THEN 0.4 ELSE 1.0 END)::DOUBLE * greatest(own_v, 0.5)::DOUBLE / greatest(rest, 1)::DOUBLE END)) AS log_score
  FROM x GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_seen, 0)::BIGINT AS n_seen,
       round(coalesce(log_score, 0), 4) AS log_score, round(coalesce(log_score / n_words, 0), 6) AS mean_log_score
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""
