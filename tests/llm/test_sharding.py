from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagelathe.llm import numbering, sharding
from pagelathe.llm.queries import SHARDS, op7_sharding
from tests.llm import brute
from tests.llm.fixtures import documents, empty
from tests.oracle import SMALL, duck_rows, spark_rows


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 200), *(7**k % (1 << 62) for k in range(1, 60))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 17, 100):
        got = {r["k"]: r["s"] for r in df.withColumn("s", sharding.jump_shard(F.col("k"), shards)).collect()}
        assert got == {k: brute.jump(k, shards) for k in keys}


def test_growth_moves_only_into_the_new_shard(spark):
    rows = spark.range(20_000).select(sharding.jump_shard(F.col("id"), 16).alias("a"), sharding.jump_shard(F.col("id"), 17).alias("b")).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == 16 for r in moved)
    assert abs(len(moved) / len(rows) - 1 / 17) < 0.01
    assert max(Counter(r["a"] for r in rows).values()) < 1.15 * len(rows) / 16


def test_awkward_rows(spark):
    docs = documents(spark)
    got = sharding.assign(docs, SHARDS).collect()
    assert len(got) == docs.count()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, brute.crc(r["text"]), brute.jump(-1 if r["doc_id"] is None else r["doc_id"], 16), brute.jump(-1 if r["doc_id"] is None else r["doc_id"], 17)) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_shard_holds_all(spark, monkeypatch):
    """A group over many ranges is numbered without gaps."""
    monkeypatch.setattr(numbering, "ROWS_PER_RANGE", 100)
    df = spark.range(3000).select(F.lit(None).cast("int").alias("g"), F.col("id"))
    df = df.unionByName(spark.range(5).select(F.lit(1).alias("g"), "id"))
    got = numbering.gapless(df, ["g"], ["id"], "n").collect()
    assert all(r["n"] == r["id"] for r in got)
    assert len(got) == 3005


def test_written_shards_are_whole(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert {f.name for f in (tmp_path / "out").iterdir() if f.is_dir()} <= {f"shard={i}" for i in range(4)}


def test_empty_table(spark):
    assert sharding.assign(empty(spark), SHARDS).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = sharding.assign(documents(spark), SHARDS)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_query_equals_its_oracle(spark):
    assert spark_rows(op7_sharding(spark, SMALL)) == duck_rows(sharding.ORACLE)
