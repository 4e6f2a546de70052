from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelathe.llm import mixing
from pagelathe.llm.queries import op9_mixing
from tests.llm import brute
from tests.llm.fixtures import documents, empty, sentence
from tests.oracle import SMALL, duck_rows, spark_rows


def targets_of(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r["source"]: r["target"] for r in mixing.targets(rows).collect()}


def expected(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))]
    return dict(zip(order, brute.water_fill([sizes[s] for s in order], weights, 1.5, 2.0), strict=True))


@settings(max_examples=25, deadline=None)
@given(sizes=st.dictionaries(st.one_of(st.none(), st.text(alphabet="abé中\U0001F600", max_size=3)), st.integers(0, 1000), min_size=1, max_size=7))
def test_targets_fill_like_water(sizes):
    from pyspark.sql import SparkSession

    got, want = targets_of(SparkSession.active(), sizes), expected(sizes)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.plan(docs).collect()
    held = docs.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in held)
    sizes = Counter()
    for r in held:
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = expected(dict(sizes))
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark)
    a = Counter(map(tuple, mixing.plan(docs).collect()))
    b = Counter(map(tuple, mixing.plan(docs.repartition(7, "text")).collect()))
    assert a == b


def test_taken_words_come_near_the_targets(spark):
    import random

    rng = random.Random(1)
    rows = [sentence(rng, rng.randint(1, 40)) for _ in range(6000)]
    got = mixing.plan(documents(spark, rows, clashing=False)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.05)


def test_mix_repeats_whole_rows(spark):
    docs = documents(spark)
    once = docs.where("doc_id IS NOT NULL AND doc_id <> 3")
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(once).collect()}
    out = mixing.mix(once)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_empty_table(spark):
    assert mixing.plan(empty(spark)).collect() == []
    assert mixing.mix(empty(spark)).collect() == []


def test_no_python_on_the_main_path(spark):
    for df in (mixing.plan(documents(spark)), mixing.mix(documents(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan
        assert "Arrow" not in plan


def test_query_equals_its_oracle(spark):
    assert spark_rows(op9_mixing(spark, SMALL)) == duck_rows(mixing.ORACLE)
