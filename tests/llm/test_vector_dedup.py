from __future__ import annotations

import numpy as np
import pytest

from pagelathe.llm import vector_dedup as vd
from pagelathe.llm.queries import op10_vector_dedup
from tests.llm import brute
from tests.oracle import SMALL, duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int, bucket string, task string, v string, component string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def expected(rows):
    """(id, links, component, kept) by comparing all pairs of a label."""
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, np.float32).astype(float)
        unit[k] = (label, a / np.linalg.norm(a))
    links, edges = dict.fromkeys(range(len(rows)), 0), []
    for a in unit:
        for b in unit:
            if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= vd.THRESHOLD:
                links[a] += 1
                links[b] += 1
                edges.append((rows[a][0], rows[b][0]))
    comp = brute.reach({r[0] for r in rows if r[0] is not None}, edges)
    return sorted(((r[0], links[k], None if r[0] is None else comp[r[0]], r[0] is None or comp[r[0]] == r[0]) for k, r in enumerate(rows)), key=str)


def got_of(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1),
        (9, [inf, 1.0, 0.0], 1), (10, [1.0, None, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (14, [1e38, 1e36, 0.0], 1), (15, [1e-38, 0.0, 0.0], 1), (16, [-1.0, 0.0, 0.0], 1),
    ]
    assert got_of(vd.assign(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("block", [256, 16])
def test_hot_label_and_copies(spark, monkeypatch, block):
    """A label with most rows, a large group of copies and of near copies, and buckets larger than a block."""
    monkeypatch.setattr(vd, "BLOCK", block)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(150)]
    rows += [(i, centre.tolist(), 1) for i in range(150, 200)]
    rows += [(i, rng.normal(size=16).tolist(), int(rng.integers(1, 3))) for i in range(200, 420)]
    assert got_of(vd.assign(table(spark, rows))) == expected([(i, v, label) for i, v, label in rows])


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs just above the bound: at least 0.99 of the links are found, none below the bound."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        b -= (a @ b) / (a @ a) * a
        angle = np.arccos(0.9305)
        c = np.cos(angle) * a / np.linalg.norm(a) + np.sin(angle) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, c.tolist(), 1)]
    got = {r["vec_id"]: r["n_links"] for r in vd.assign(table(spark, rows)).collect()}
    want = {r[0]: r[1] for r in expected(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_parameters_keep_the_miss_rate():
    for n in (1, 100, 10**6, 10**10):
        bits, tables = vd.parameters(n)
        agree = (1 - np.arccos(vd.THRESHOLD) / np.pi) ** bits
        assert (1 - agree) ** tables <= vd.MISS


def held(store):
    runs = store.executionsList()
    return [runs.apply(k) for k in range(runs.size())]


def test_driver_gets_no_table(spark):
    """No step broadcasts rows of the vectors, codes, buckets or results, however small their files are."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, v, label) for i, v, label in rows[:40]]
    store = spark._jsparkSession.sharedState().statusStore()
    done = {e.executionId() for e in held(store)}
    assert got_of(vd.assign(table(spark, rows))) == expected(rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription().partition("== Initial Plan ==")[0] for e in held(store) if e.executionId() not in done]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_empty_table(spark):
    assert vd.assign(table(spark, [])).collect() == []


def test_query_equals_its_oracle(spark):
    assert spark_rows(op10_vector_dedup(spark, SMALL)) == duck_rows(vd.ORACLE)
