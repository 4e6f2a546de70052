"""Encoding and decoding against the sentencepiece library itself."""

from __future__ import annotations

import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelathe.llm import sentencepiece_bpe as sp
from pagelathe.llm.queries import model_path, op1_sentencepiece
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def model():
    return sp.Model(model_path())


def expected(library, text: str | None) -> tuple[list[int], str]:
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def check(model, library, text: str) -> None:
    packed, decoded = model.encode(text)
    ids, told = expected(library, text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
    assert decoded == told
    assert model.decode(packed) == told


CASES = [
    "", " ", "  ", "a", " a", "a ", "Hello world", "Hello  world", "   lead", "trail   ", "line\nbreak", "\n", "\n\n \n", "tab\tstop", "a\r\nb", "▁", "▁▁a", "x▁y",
    "naïve café", "東京都に住む", "🎉🎉", "é", " ", "​‍", "\x00nul", "a\x00b", "�", "﻿mark", "ab" * 400, "x" * 5000, "0123456789" * 30,
    "<s> </s> <unk> <0x41>", "\U0010ffff", "ﬁ ligature Ａ", "aaaaaaaaaaaaaaaaab", "the theththe tthhee", "  \n  indent\n\tcode()", "مرحبا بالعالم", "שלום", "привет мир",
]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(model, library, text):
    check(model, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst \n▁'.,-ABT019éß中ー🎉"), st.characters(exclude_categories=("Cs",))), max_size=80))
def test_equals_the_library_on_any_text(text):
    check(sp.model(model_path()), LIBRARY, text)


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_backtracking_agrees_with_merging(model):
    """The definition itself, on chunks without a library's help."""
    for word in ("unbelievable", "thethe", "internationalization", "xylophones", "aaaaaaaa", "Zusammenhang"):
        told = model.merge("▁" + word)
        assert [model.pieces[i] for i in model.chunk_ids("▁" + word)] == told


def test_decode_of_broken_bytes(model, library):
    """Byte pieces that are no UTF-8, as a model may return them."""
    for run in ([0xE6], [0xFF, 0x41], [0xE6, 0x9D], [0xC3, 0xA9], [0xF0, 0x9F, 0x8E]):
        ids = [model.bytes[b] for b in run] + [library.piece_to_id("▁a")]
        assert model.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_bounded_tables_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(sp, "KEEP_CHUNKS", 3)
    monkeypatch.setattr(sp, "KEEP_PAIRS", 3)
    small = sp.Model(model_path())
    for text in CASES[:20] * 2:
        check(small, library, text)


def test_documents_with_awkward_rows(spark, library):
    docs = documents(spark)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sp.digests(sp.encode(docs, model_path())).collect()}
    want = set()
    for r in docs.collect():
        ids, told = expected(library, r["text"])
        want.add((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    assert got == want


def test_empty_table(spark):
    assert sp.digests(sp.encode(empty(spark), model_path())).collect() == []


def test_query_over_the_whole_table(spark, library):
    rows = {r["doc_id"]: r for r in op1_sentencepiece(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, told = expected(library, d["text"])
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(told.encode()).hexdigest())
