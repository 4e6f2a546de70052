"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of words and word beginnings, second-person words near
lexicon words, capitals, punctuation, and obfuscation (letters replaced by digits or signs). The
lexicon, the trees and the calibration are learned here from labelled rows: a bounded sample of SAMPLE
rows by hash of the id, with SAMPLE_BYTES of text. Texts of more than TEXT_BYTES are taken last, and a
text that does not fit is passed over, so a few very long ones do not use up the sample.

Labels, lang, source and doc_id are no inputs of a score. Rows whose crc32 of the id mod 3 is 1 are
held out of learning.

Scale: the sample's ids are a top-k of narrow rows, its texts come by a broadcast join of at most
SAMPLE ids; the model is a few kilobytes. Scoring is one pass without shuffle.

Defined results: null texts count as empty and are scored like any text; null ids are never held out nor
learned from; null labels are ignored and of several labels for an id the largest holds. Without both
labels in the sample every score is the sample's share of toxic rows, 0 for none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.runtime import ship_package

#: Bounds of the sample: rows, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 8_000, 32 << 20
#: Texts above are learned from only as far as the others leave room.
TEXT_BYTES = 128 << 10
CUT = 0.7
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
FOLDS = 3
#: Lengths of the word beginnings that are looked at.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Entries that the learner keeps for words.
KEEP_TERMS = 100_000
#: Toxic texts that must hold a word, and a beginning.
LEAST = (5, 8)
KEEP_WORDS, KEEP_LENGTH, ROWS = 300_000, 64, 256

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_TRIM = ".,;:!?\"'()[]{}<>*#%&$+=-_/\\~`^|…«»¿¡“”‘’"
_STRETCH = re.compile(r"(.)\1{2,}")
#: What is known of a word, as bits.
LEXICON, BEGINNING, HIDDEN, YOU, CAPITALS, MIXED, STRETCHED = (1 << i for i in range(7))
FEATURES = 18


def plain(word: str) -> str:
    return word.lower().strip(_TRIM)


def unhidden(word: str) -> str:
    """The word with look-alike signs as letters, inner signs dropped and stretched letters shortened."""
    return _STRETCH.sub(r"\1", re.sub(r"[\W_\d]+", "", word.lower().strip(".,;:!?\"'()").translate(_LEET)))


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    beginnings: frozenset[str] = frozenset()
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"words": self.words, "beginnings": self.beginnings, "_known": {}}

    def _hit(self, w: str) -> int:
        return LEXICON if w in self.words else BEGINNING if any(w[:k] in self.beginnings for k in BEGINNINGS if len(w) >= k) else 0

    def bits(self, word: str) -> int:
        w = plain(word)
        out = self._hit(w) | (YOU if w in _YOU else 0)
        core = word.strip(_TRIM)
        if len(core) > 2 and core.isupper():
            out |= CAPITALS
        letters = sum(map(str.isalpha, core))
        if 1 < letters < len(core) and core[0] != core[-1] and any(not c.isalpha() and c not in "-'’.@/:" for c in core[1:-1]):
            out |= MIXED
        if _STRETCH.search(core):
            out |= STRETCHED
        if not out & (LEXICON | BEGINNING) and letters >= 2:
            u = unhidden(word)
            if u != w and (u in self.words or self._hit(u)):
                out |= HIDDEN
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > KEEP_WORDS:
            known.clear()
        long = {}
        for w in set(words).difference(known):
            (known if len(w) <= KEEP_LENGTH else long)[w] = self.bits(w)
        if long:
            return np.fromiter((known[w] if w in known else long[w] for w in words), np.int16, len(words))
        return np.fromiter(map(known.__getitem__, words), np.int16, len(words))

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = _WORD.findall(text)
        n, chars = max(1, len(words)), max(1, len(text))
        code = self.codes(words)
        hit = (code & (LEXICON | BEGINNING | HIDDEN)) > 0
        you = (code & YOU) > 0
        near = 0.0
        if hit.any() and you.any():
            at, your = np.flatnonzero(hit), np.flatnonzero(you)
            pos = np.searchsorted(your, at)
            gap = np.minimum(np.abs(at - your[np.minimum(pos, len(your) - 1)]), np.abs(at - your[np.maximum(pos - 1, 0)]))
            near = float((gap <= 5).sum())
        byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
        upper, lower = byte[65:91].sum(), byte[97:123].sum()
        each = [float(((code & bit) > 0).sum()) for bit in (LEXICON, BEGINNING, HIDDEN, YOU, CAPITALS, MIXED, STRETCHED)]
        hits = float(hit.sum())
        return [
            each[0] / n, each[1] / n, each[2] / n, hits / n, np.log1p(hits), np.log1p(each[0]), np.log1p(each[1]), np.log1p(each[2]), near / n, np.log1p(near),
            each[3] / n, each[4] / n, each[5] / n, each[6] / n, float(upper) / max(1.0, float(upper + lower)), float(byte[33]) / chars, float(byte[35:39].sum() + byte[42] + byte[64]) / chars, float(np.log1p(len(words))),
        ]


def terms(word: str) -> list[str]:
    """The word and, marked by ^, its beginnings."""
    w = plain(word)
    return [w, *(f"^{w[:k]}" for k in BEGINNINGS if len(w) >= k and w[:k].isalpha())] if w else []


class TermCounts:
    """In how many toxic and other texts a term stands, by fold; equal texts count once.

    Only terms that enough toxic texts hold are counted in the others, so the tables stay small.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, folds: int) -> None:
        self.texts = np.zeros((folds, 2))
        self.counts = [(Counter(), Counter()) for _ in range(folds)]
        once = dict(zip(texts, toxic.tolist(), strict=True))
        often: Counter = Counter()
        for text in (t for t, y in once.items() if y):
            often.update({t for w in set(_WORD.findall(text)) for t in terms(w)})
        wanted = {t for t, a in often.items() if a >= LEAST[t[0] == "^"]}
        del often
        known: dict[str, tuple[str, ...]] = {}
        for text, y in once.items():
            if len(known) > KEEP_TERMS:
                known.clear()
            fold = fold_of(text, folds)
            self.texts[fold, int(y)] += 1
            found = set(_WORD.findall(text))
            for w in found.difference(known):
                known[w] = tuple(t for t in terms(w) if t in wanted)
            self.counts[fold][y].update({t for w in found for t in known[w]})

    def lexicon(self, without: int | None = None) -> Lexicon:
        """What toxic texts hold far more often than others, in all folds but one."""
        used = [k for k in range(len(self.counts)) if k != without]
        rest, bad = self.texts[used].sum(axis=0).tolist()
        often = sum((self.counts[k][1] for k in used), Counter())
        telling = [t for t, a in often.items() if a >= LEAST[t[0] == "^"] and (a + 0.5) / bad >= 20 * (sum(self.counts[k][0][t] for k in used) + 0.5) / rest]
        return Lexicon(frozenset(t for t in telling if t[0] != "^"), frozenset(t[1:] for t in telling if t[0] == "^"))


def fold_of(text: str, folds: int) -> int:
    """Equal texts share a fold."""
    return crc32(text.encode("utf-8", "replace")) % folds


@dataclass
class Booster:
    """Logistic gradient boosting with small trees on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.edges = []
        for j in range(x.shape[1]):
            some = np.unique(x[:, j])
            self.edges.append(np.unique(np.quantile(some, np.linspace(0, 1, BINS)[1:-1])) if len(some) > 1 else np.zeros(0))
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        bins, margin = self._binned(x), np.full(len(y), self.base)
        nodes = (1 << DEPTH) - 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
            node = np.zeros(len(y), np.int64)
            for k in range(nodes):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, BINS)
                if len(rows) >= 20:
                    for j in range(x.shape[1]):
                        g = np.cumsum(np.bincount(bins[rows, j], grad[rows], BINS))
                        h = np.cumsum(np.bincount(bins[rows, j], hess[rows], BINS))
                        gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                        b = int(np.argmax(gain[:-1]))
                        if gain[b] > best[0]:
                            best = (float(gain[b]), j, b)
                feature[k], cut[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (bins[rows, best[1]] > best[2])
            leaf = node - nodes
            g, h = np.bincount(leaf, grad, nodes + 1), np.bincount(leaf, hess, nodes + 1)
            value = -RATE * g / (h + 1)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve from margin to probability."""
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    values, where = np.unique(margin, return_inverse=True)
    for v, s, w in zip(values, np.bincount(where, y), np.bincount(where), strict=True):
        blocks.append([s, w, v * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Scorer:
    lexicon: Lexicon
    booster: Booster | None
    xs: np.ndarray
    ys: np.ndarray
    share: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.booster is None:
            return np.full(len(texts), self.share)
        margin = self.booster.margin(np.array([self.lexicon.features(t) for t in texts], float).reshape(len(texts), FEATURES))
        # The raw probability orders what the calibration ties.
        return np.clip(0.999 * np.interp(margin, self.xs, self.ys) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def train(texts: list[str], toxic: np.ndarray) -> Scorer:
    """From rows in hash order.

    Features of a row come from a lexicon that was learned without the row's fold, so trees and
    calibration see words as they will see them in new texts; the lexicon that stays is learned from all
    rows. Trees are fitted on three fifths of the rows, the calibration on the rest.
    """
    n = len(texts)
    share = float(toxic.mean()) if n else 0.0
    cut = 3 * n // 5
    if n < 2 * FOLDS or any(p.all() or not p.any() for p in (toxic[:cut], toxic[cut:])):
        return Scorer(Lexicon(), None, np.zeros(1), np.zeros(1), share)
    counts = TermCounts(texts, toxic, FOLDS)
    if (counts.texts.sum(axis=0) - counts.texts).min() < 1:
        return Scorer(Lexicon(), None, np.zeros(1), np.zeros(1), share)
    rows = np.zeros((n, FEATURES))
    for k in range(FOLDS):  # one after the other, as each keeps what it knows of words
        lexicon = counts.lexicon(k)
        for i, t in enumerate(texts):
            if fold_of(t, FOLDS) == k:
                rows[i] = lexicon.features(t)
        del lexicon
    booster = Booster().fit(rows[:cut], toxic[:cut].astype(float))
    xs, ys = isotonic(booster.margin(rows[cut:]), toxic[cut:].astype(float))
    return Scorer(counts.lexicon(), booster, xs, ys, share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Learn from at most `sample` labelled rows that are not held out, with SAMPLE_BYTES of text, in the order of a hash.

    Where rows are passed over, further ids are looked at until the rows or half of the bytes are used.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_toxic"))
    known = known.where(~held_out(F.col("_id"))).withColumn("_order", F.xxhash64("_id", F.lit("sample")))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_size")
    seen: list[tuple[int, int]] = []  # order and bytes of the rows that may be taken
    tables, after = [], None
    while True:
        rest = known if after is None else known.where(F.struct("_order", "_id") > F.struct(F.lit(after[0]).alias("_order"), F.lit(after[1]).cast(known.schema["_id"].dataType).alias("_id")))
        chosen = rest.orderBy("_order", "_id").limit(sample)
        held = docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select("_order", "_id", F.col(text_col).alias("_text"), "_toxic").withColumn("_size", size)
        tables.append(held)
        # The limits hold for rows that repeat an id, too.
        found = [(r["_order"], r["_size"]) for r in held.select("_order", "_size").orderBy("_order", "_size").limit(sample).collect()]
        seen += found
        taken = fitting(seen, sample)
        if len(taken) >= sample or sum(n for _, n in taken) >= SAMPLE_BYTES // 2 or len(taken) == len(seen):
            break
        seen = [r for r in seen if r[1] <= SAMPLE_BYTES]
        ends = chosen.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_order", "_id")).alias("last")).first()
        if ends["n"] < sample:
            break
        after = ends["last"]
    rows = []
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(*r, k) for r, k in Counter(taken).items()], "_o long, _n long, _k long"))
    same = Window.partitionBy("_order", "_size").orderBy("_id", "_text")
    for held in tables:
        part = held.join(picked, (F.col("_order") == F.col("_o")) & (F.col("_size") == F.col("_n")))
        part = part.withColumn("_nth", F.row_number().over(same)).where("_nth <= _k").select("_order", "_id", "_text", "_toxic")
        part = part.orderBy("_order", "_id", "_text").limit(sample).toArrow()
        rows += zip(part.column("_text").to_pylist(), part.column("_toxic").to_pylist(), strict=True)
        del part
    texts, toxic = [t or "" for t, _ in rows], np.array([y for _, y in rows], bool)
    del rows, seen, taken
    return train(texts, toxic)


def fitting(rows: list[tuple[int, int]], sample: int, most: int | None = None, long: int | None = None) -> list[tuple[int, int]]:
    """The (order, bytes) that are taken: texts of up to `long` bytes first, none that would bring the sum over `most`."""
    most, long = SAMPLE_BYTES if most is None else most, TEXT_BYTES if long is None else long
    out, used = [], 0
    for row in sorted(rows, key=lambda r: r[1] > long):
        if len(out) < sample and used + row[1] <= most:
            out.append(row)
            used += row[1]
    return out


def held_out(id_col) -> F.Column:
    """Whether the crc32 of the id as text has remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score CUT or more; columns stay as they are."""
    scorer = fit(docs, labels, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) < CUT))

    return docs.mapInArrow(run, docs.schema)
