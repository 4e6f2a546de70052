from __future__ import annotations

import numpy as np
import pytest

from pagelathe.llm import ngram_lm
from pagelathe.llm.queries import op4_ngram_lm
from tests.llm import brute
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL, duck_rows, spark_rows


def got_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_seen"], r["log_score"]) for r in df.collect()), key=str)


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    np.testing.assert_allclose([x[3] for x in a], [x[3] for x in b], atol=2e-4)


@pytest.mark.parametrize("group_bytes", [1 << 24, 4000, 500])
def test_awkward_rows_equal_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(ngram_lm, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(ngram_lm, "PART_BYTES", 1)
    docs = documents(spark)
    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    close(got_of(ngram_lm.score(docs)), sorted(brute.backoff_scores(held), key=str))


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (ngram_lm.unpack(ngram_lm.pack(v)) == v).all()
        c = rng.integers(1, 1000, n)
        assert (ngram_lm.unpack_counts(ngram_lm.pack_counts(c)) == c).all()


def test_empty_table(spark):
    assert ngram_lm.score(empty(spark)).collect() == []


def test_query_equals_its_oracle(spark):
    assert spark_rows(op4_ngram_lm(spark, SMALL)) == duck_rows(ngram_lm.ORACLE)
