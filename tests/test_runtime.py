from __future__ import annotations

import os

import pytest

import __spark_entry__
from pagelathe import runtime


def test_entry_and_queries(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert "content" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_materialised_tables_cut_the_lineage(spark):
    df = runtime.materialize(spark.range(5).selectExpr("id", "id * 2 AS b"), "test")
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(5)]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_tables_can_be_materialised(spark):
    df = runtime.materialize(spark.createDataFrame([], "a long, b array<string>"), "test")
    assert df.collect() == []
    assert df.dtypes == [("a", "bigint"), ("b", "array<string>")]


def test_free_names(spark):
    assert runtime.free_name(spark.createDataFrame([(1, 2)], "x long, _X long"), "X") == "__X"


def test_released_tables_are_gone(spark):
    df = runtime.materialize(spark.range(5), "test")
    path = df._pagelathe_path.removeprefix("file:")
    assert os.path.isdir(path)
    runtime.release(df)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Told:
        """A session on a cluster without spark.checkpoint.dir."""

        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

            class _jsc:
                sc = staticmethod(lambda: type("Context", (), {"getCheckpointDir": lambda self: type("Option", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Told)
