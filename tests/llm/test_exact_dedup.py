from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pagelathe.llm import exact_dedup
from pagelathe.llm.queries import op3_exact_dedup
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL, duck_rows, spark_rows


def low(i):
    return float("-inf") if i is None else i


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max(groups[t or ""], key=low), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = exact_dedup.assign(docs).collect()
    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected(held)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in held})  # one of each text, repeated ids or not
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_long_common_prefixes(spark, monkeypatch):
    """Texts that differ after any run of bytes, and one that ends where another goes on."""
    monkeypatch.setattr(exact_dedup, "FIRST_RUN", 2)
    monkeypatch.setattr(exact_dedup, "GROWTH", 2)
    rows = ["a" * n for n in range(0, 70)] * 2 + ["a" * 64 + "b", "a" * 63 + "b", "é" * 20, "é" * 20 + "a", "é" * 20]
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.assign(docs).collect()), key=str)
    assert got == expected(list(enumerate(rows, 1)))


def test_group_of_thousands(spark):
    rows = ["copy " * 40] * 3000 + ["other"] * 2 + [str(i) for i in range(500)]
    got = exact_dedup.assign(documents(spark, rows, clashing=False))
    assert got.where("kept").count() == 502
    assert got.agg(F.max("group_size")).first()[0] == 3000


def test_normalised(spark):
    docs = documents(spark, ["A b", "a B", "c"])
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.assign(docs, normalise=F.lower("text")).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_drop_returns_whole_rows(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({r["text"] or "" for r in rows}) == len({r["text"] or "" for r in docs.select("text").collect()})


def test_drop_with_repeated_ids_and_texts(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, "same"), (1, "other"), (None, "x")], key=str)


def test_empty_table(spark):
    assert exact_dedup.assign(empty(spark)).collect() == []
    assert exact_dedup.drop_duplicates(empty(spark)).collect() == []


def test_query_equals_its_oracle(spark):
    assert spark_rows(op3_exact_dedup(spark, SMALL)) == duck_rows(exact_dedup.ORACLE)
