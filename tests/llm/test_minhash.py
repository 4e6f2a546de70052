from __future__ import annotations

import random

from pagelathe.llm import minhash
from pagelathe.llm.queries import op2_minhash
from tests.llm import brute
from tests.llm.fixtures import documents, empty, sentence
from tests.oracle import SMALL, duck_rows, spark_rows


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_awkward_rows_equal_brute_force(spark):
    docs = documents(spark)
    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for size, percent in ((3, 85), (5, 80)):
        assert rows_of(minhash.assign(docs, size=size, percent=percent)) == sorted(brute.near_duplicates(held, size, percent), key=str)


def test_hot_group_chains_and_pairs_at_the_threshold(spark):
    """A group larger than a block, chains of small edits, and pairs on both sides of the bound."""
    rng = random.Random(3)
    base = sentence(rng, 90).split(" ")
    rows = []
    for i in range(330):  # one large region: the same text but for a word at the end
        rows.append(" ".join([*base, f"tail{i}"]))
    for _ in range(12):  # a chain that drifts
        chain = list(base)
        for step in range(12):
            chain[(7 * step) % 90] = f"step{rng.random()}"
            rows.append(" ".join(chain))
    for cut in range(60, 90):
        rows.append(" ".join(base[:cut]))
    rows += [sentence(rng, rng.randint(1, 50)) for _ in range(60)]
    rng.shuffle(rows)
    docs = documents(spark, rows, clashing=False)
    want = brute.near_duplicates(list(enumerate(rows, 1)), 3, 85)
    assert rows_of(minhash.assign(docs, size=3, percent=85)) == sorted(want, key=str)


def test_large_region_with_several_components(spark, monkeypatch):
    """The exact way for what sorting leaves apart: small blocks, members spread over components."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    base = sentence(rng, 120).split(" ")
    rows = []
    for _ in range(70):
        other = list(base)
        for _ in range(rng.randint(0, 8)):
            other[rng.randrange(120)] = f"w{rng.randint(0, 400)}"
        rows.append(" ".join(other))
    docs = documents(spark, rows, clashing=False)
    want = brute.near_duplicates(list(enumerate(rows, 1)), 3, 85)
    assert rows_of(minhash.assign(docs, size=3, percent=85)) == sorted(want, key=str)


def test_depth_keeps_recall():
    for percent in (80, 85, 90):
        s, d = percent / 100, minhash.depth_for(percent)
        assert (1 - s**d) ** minhash.TREES <= minhash.MISS or d == 1


def test_drop_keeps_columns_and_smallest_ids(spark):
    docs = documents(spark)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [i for i, _, _, k in brute.near_duplicates(held, 5, 80) if k]
    assert sorted(ids, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert minhash.assign(empty(spark)).collect() == []
    assert minhash.drop_near_duplicates(empty(spark)).collect() == []


def test_query_equals_its_oracle(spark):
    assert spark_rows(op2_minhash(spark, SMALL)) == duck_rows(minhash.ORACLE)


def test_a_repeated_id_has_the_links_of_each_of_its_texts(spark):
    """Both texts of id 2 are looked for, and its rows are one node."""
    rng = random.Random(21)
    a, b = sentence(rng, 60), sentence(rng, 60)
    held = [(2, a), (2, b), (3, f"{a} more"), (4, f"{b} more"), (5, sentence(rng, 60)), (1, sentence(rng, 60))]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    assert rows_of(minhash.assign(docs)) == sorted(brute.near_duplicates(held, 5, 80), key=str)
    held = [(1, a), (2, a), (2, b), (4, f"{b} more")]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    assert {(r["component_id"], r["kept"]) for r in minhash.assign(docs).collect() if r["doc_id"] == 2} == {(1, False)}
    assert [r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect()] == [1]


def test_pairs_at_the_threshold_whatever_the_room(spark, monkeypatch):
    """Pairs on both sides of the bound inside crowds that share half of their words; regions parted at once, or as usual."""
    rng = random.Random(31)
    rows = []
    for _ in range(12):
        shared = [f"s{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(6):
            own = shared + [f"o{rng.randint(0, 10**6)}" for _ in range(60)]
            for cut in (0, 8, 9, 10):  # 118 shingles of 3 words: 8 words off leave a similarity of 0.87, 9 of 0.855, 10 of 0.84
                rows.append(" ".join([*own[cut:], *[f"e{rng.randint(0, 10**6)}" for _ in range(cut and rng.randint(0, 2))]]))
    rng.shuffle(rows)
    docs = documents(spark, rows, clashing=False)
    want = sorted(brute.near_duplicates(list(enumerate(rows, 1)), 3, 85), key=str)
    for room in (1, minhash.ROOM):
        monkeypatch.setattr(minhash, "ROOM", room)
        assert rows_of(minhash.assign(docs, size=3, percent=85)) == want
