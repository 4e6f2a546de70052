from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import toxicity
from pagelathe.llm.queries import op5_toxicity
from tests.llm.fixtures import documents, empty

DATA = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):  # ties share their mean rank
        rank[score == v] = rank[score == v].mean()
    pos = label.sum()
    return (rank[label].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


@pytest.fixture(scope="module")
def scored(spark):
    return op5_toxicity(spark, DATA).cache()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    y, p = rows["toxic"].to_numpy() > 0, rows["predicted"].to_numpy() > 0
    assert auc(rows["score"].to_numpy(), y) >= 0.97
    assert (p & y).sum() / max(1, p.sum()) >= 0.9
    assert (p & y).sum() / y.sum() >= 0.85


def test_scores_are_probabilities_and_rows_whole(spark, scored):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert scored.count() == docs.count()
    bad = scored.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)")
    assert bad.count() == 0


def test_held_out_is_a_crc_of_the_id(spark):
    rows = spark.range(300).withColumn("h", toxicity.held_out(F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_play_no_part(spark):
    """Labels of held-out rows may be anything."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas().sort_values("doc_id")
    b = toxicity.score(docs, toxicity.fit(docs, flipped)).toPandas().sort_values("doc_id")
    assert (a["score"].to_numpy() == b["score"].to_numpy()).all()


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 0, 0), (12, 1, 0), (999, 1, 1)], LABELS)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in out)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), none)).collect() == []
    docs = documents(spark)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).count() == docs.count()


def test_calibration_rises():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=400)
    xs, ys = toxicity.isotonic(margin, (rng.random(400) < 1 / (1 + np.exp(-margin))).astype(float))
    assert (np.diff(xs) > 0).all()
    assert (np.diff(ys) > 0).all()


def test_hidden_spellings():
    known = toxicity.Lexicon(frozenset({"villain"}), frozenset())
    for told in ("v1lla1n", "v.i.l.l.a.i.n", "viiillain", "VILLAIN!", "v!lla!n"):
        assert known.bits(told) & (toxicity.LEXICON | toxicity.HIDDEN)
    assert not known.bits("villa") & (toxicity.LEXICON | toxicity.HIDDEN)


def test_very_long_texts_do_not_use_up_the_sample(spark, monkeypatch):
    """The first rows in hash order are over the bound, or fill most of it; the others are still learned from."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1_000)
    ids = [r["id"] for r in spark.range(400).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit("sample"))).collect()]
    texts = {i: ("awful vile words here" if k % 2 else "a kind and quiet text") + f" number {i}" for k, i in enumerate(ids)}
    texts[ids[0]], texts[ids[1]], texts[ids[2]] = "long " * 9_000, "long " * 7_999, "long " * 7_998
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], LABELS)
    learned = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: learned.append((texts, toxic)))
    toxicity.fit(docs, labels)
    assert learned[0][0] == [texts[i] for i in ids[3:]]
    assert learned[0][1].tolist() == [k % 2 == 1 for k in range(3, len(ids))]
    toxicity.fit(docs, labels, sample=50)  # goes on after the first ids
    assert len(learned[1][0]) == 50
    assert learned[1][0] == [texts[i] for i in ids[3:53]]


def slow_margins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Boosting by the definition: of all cuts of all features the one with the greatest gain, row by row."""
    edges = []
    for j in range(x.shape[1]):
        some = sorted(set(x[:, j]))
        edges.append(sorted(set(np.quantile(some, np.linspace(0, 1, toxicity.BINS)[1:-1]))) if len(some) > 1 else [])
    share = float(np.mean(y))
    margin = [math.log(share / (1 - share))] * len(y)
    for _ in range(toxicity.TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        leaves = [list(range(len(y)))]
        for _ in range(toxicity.DEPTH):
            deeper = []
            for rows in leaves:
                best, parts = 1e-6, (rows, [])
                if len(rows) >= 20:
                    total = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
                    for j in range(x.shape[1]):
                        for cut in edges[j]:
                            left = [r for r in rows if x[r, j] < cut]
                            g, h = sum(grad[r] for r in left), sum(hess[r] for r in left)
                            gain = g * g / (h + 1) + (total[0] - g) ** 2 / (total[1] - h + 1) - total[0] ** 2 / (total[1] + 1)
                            if gain > best + 1e-9:
                                best, parts = gain, (left, [r for r in rows if x[r, j] >= cut])
                deeper += parts
            leaves = deeper
        for rows in leaves:
            value = -toxicity.RATE * sum(grad[r] for r in rows) / (sum(hess[r] for r in rows) + 1)
            for r in rows:
                margin[r] += value
    return np.array(margin)


def test_trees_equal_the_definition(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 5)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 4)), 2)
    y = (x[:, 0] + x[:, 2] ** 2 + rng.normal(size=120) / 2 > 0.8).astype(float)
    assert np.allclose(toxicity.Booster().fit(x, y).margin(x), slow_margins(x, y), atol=1e-9)


def test_calibration_equals_the_definition():
    """Isotonic regression by its min-max formula; ties of the margin are one point."""
    rng = np.random.default_rng(9)
    margin = np.round(rng.normal(size=150), 1)
    y = (margin + rng.normal(size=150) > 0).astype(float)
    values = np.unique(margin)
    means = [[float(np.mean(y[(margin >= a) & (margin <= b)])) if a <= b else None for b in values] for a in values]
    want = [max(min(means[a][b] for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    xs, ys = toxicity.isotonic(margin, y)
    assert (np.diff(ys) > 0).all()
    for v, w in zip(values, want, strict=True):
        assert np.isclose(ys[np.argmin(np.abs(ys - w))], w)
    assert np.isclose(np.interp(values[0], xs, ys), want[0])
    assert np.isclose(np.interp(values[-1], xs, ys), want[-1])
    assert set(np.round(ys, 9)) == set(np.round(want, 9))
