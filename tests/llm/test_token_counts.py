from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelathe.llm import token_counts as tc
from pagelathe.llm.queries import model_path, op6_token_counts
from tests.llm import brute
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL

VOCABULARY = set(tc.vocabulary(model_path()))


def expected(text):
    words = brute.WORD.findall(text or "")
    return len(words), sum(brute.greedy_pieces(w, VOCABULARY) for w in words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinrst ThA'.,0é中🎉▁\n", max_size=60))
def test_any_text(text):
    assert tc.machine(model_path()).counts(text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="▁ab", min_size=1, max_size=5), min_size=1, max_size=12), st.text(alphabet="ab", min_size=1, max_size=14))
def test_any_vocabulary(pieces, word):
    assert tc.Automaton(sorted(pieces)).count(word) == brute.greedy_pieces(word, pieces)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tc.count_tokens(docs, model_path()).collect()), key=str)
    assert got == sorted(((r["doc_id"], *expected(r["text"])) for r in docs.collect()), key=str)


def test_empty_table(spark):
    assert tc.count_tokens(empty(spark), model_path()).collect() == []


def test_query_over_the_whole_table(spark):
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in op6_token_counts(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert rows == {d["doc_id"]: expected(d["text"]) for d in docs}
