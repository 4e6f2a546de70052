"""The network path end to end, with a tiny model whose file is spelled out here field by field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagelathe.operators import features as ft
from pagelathe.operators.decode import LABELS, OnnxScorer
from pagelathe.plans.extractor import Extractor
from pagelathe.runtime import read_table
from tests.oracle import SMALL


def number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(tag: int, value: int | bytes | str) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, int):
        return number(tag << 3) + number(value)
    raw = value.encode() if isinstance(value, str) else value
    return number(tag << 3 | 2) + number(len(raw)) + raw


def tensor(name: str, values: np.ndarray) -> bytes:
    return b"".join(field(1, n) for n in values.shape) + field(2, 1) + field(8, name) + field(9, values.astype("<f4").tobytes())


def stated(name: str, *shape: int | str) -> bytes:
    dims = b"".join(field(1, field(1, n) if isinstance(n, int) else field(2, n)) for n in shape)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))


def node(op: str, inputs: list[str], output: str) -> bytes:
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op)


def network(dense: np.ndarray, css: np.ndarray) -> bytes:
    """output = input @ dense + css @ css"""
    nodes = [node("MatMul", ["input", "dense"], "x"), node("MatMul", ["css", "weights"], "y"), node("Add", ["x", "y"], "output")]
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + field(5, tensor("dense", dense)) + field(5, tensor("weights", css))
    graph += field(11, stated("input", 1, "n", 9)) + field(11, stated("css", 1, "n", 43)) + field(12, stated("output", 1, "n", 5))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_a_network_scores_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    dense, css = rng.normal(size=(9, 5)) / 10, rng.normal(size=(43, 5)) / 10
    path = tmp_path / "tiny.onnx"
    path.write_bytes(network(dense, css))
    scorer = OnnxScorer(str(path))
    pages = read_table(spark, SMALL, "pages")
    rows = scorer.apply(ft.network_inputs(pages)).select("page_id", "f_dense", "f_css", "logits", F.transform("blocks", lambda b: b["text"]).alias("texts")).collect()
    want = {}
    for r in rows:
        raw = np.array(r["f_dense"], np.float32) @ dense.astype(np.float32) + np.array(r["f_css"], np.float32) @ css.astype(np.float32)
        got = np.array([[x[n] for n in LABELS] for x in r["logits"]])
        assert np.allclose(got, raw, atol=1e-2, rtol=1e-3)
        want[r["page_id"]] = "\n".join(t for t, x in zip(r["texts"], got[:, 0], strict=True) if x > 0) or None
    records = Extractor(network=scorer)(pages).select("page_id", "content", "title", "_error").collect()
    assert {r["page_id"]: r["content"] for r in records} == want
    assert all(r["title"] and r["_error"] is None for r in records)
