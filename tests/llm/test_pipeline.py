"""The pipeline against a brute-force version of its stages, and its bookkeeping."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter, defaultdict

import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from pagelathe.llm import mixing, toxicity
from pagelathe.llm.queries import model_path
from tests.llm import brute
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL


def copies(rows):
    """How often the mix takes each row (doc_id, text, source)."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, brute.water_fill([sizes[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5, 2.0), strict=True))
    for i, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        told = f"{mixing.SEED}:{'null' if i is None else i}:{len(brute.words(t))}:0"
        draw = int(hashlib.md5(told.encode()).hexdigest()[:13], 16) / (1 << 52)
        yield i, t, int(rate) + (draw < rate - int(rate))


def expected(rows, scores):
    """Rows (doc_id, text, source) and toxicity by (doc_id, text) to the pipeline's rows."""
    rows = [r for r in rows if scores[r[0], r[1]] < toxicity.CUT]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    rows = [max(g, key=lambda r: float("-inf") if r[0] is None else r[0]) for g in groups.values()]
    near = {i: k for i, _, _, k in brute.near_duplicates([(r[0], r[1]) for r in rows], 5, 80)}
    rows = [r for r in rows if near[r[0]]]
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    out = Counter()
    for i, t, n in copies(rows):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        out[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    return +out


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_equals_brute_force(spark, tmp_path, which):
    folder = SMALL
    if which == "awkward":
        folder = str(tmp_path)
        documents(spark).where("doc_id IS NULL OR doc_id <> 3").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scorer = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(i, t): scorer.score([t])[0] for i, t, _ in held}
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == expected(held, scores)


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "sentencepiece"]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
