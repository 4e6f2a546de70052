from __future__ import annotations

import random

import pytest

from pagelathe.llm.components import components
from tests.llm import brute


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(400, 400 + i) for i in range(60)]
    df = spark.createDataFrame([*edges, (None, 5), (7, None), (900, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in brute.reach({x for e in edges for x in e}, edges).items() if k in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
