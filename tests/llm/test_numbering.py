from __future__ import annotations

import random
from itertools import accumulate

import pytest

from pagelathe.llm import numbering
from pagelathe.runtime import materialize


@pytest.mark.parametrize("size", [7, 20_000])
def test_running_sums_whatever_the_ranges(spark, monkeypatch, size):
    """Ties of the first column, nulls of the second, many ranges and one."""
    monkeypatch.setattr(numbering, "ROWS_PER_RANGE", size)
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), None if i % 9 == 0 else i, rng.randint(0, 100), float(i)) for i in range(90) if i % 9 or i == 0]
    df = materialize(spark.createDataFrame(rows, "a int, b int, n int, x double"), "numbers")
    got = {(r["a"], r["b"]): (r["n_to"], r["x_to"]) for r in numbering.running(df, ["a", "b"], {"n_to": "n", "x_to": "x"}).collect()}
    held = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    want = zip(accumulate(r[2] for r in held), accumulate(r[3] for r in held), strict=True)
    assert got == {(r[0], r[1]): sums for r, sums in zip(held, want, strict=True)}


def test_running_sums_of_an_empty_table(spark):
    df = materialize(spark.createDataFrame([], "a int, n int"), "numbers")
    assert numbering.running(df, ["a"], {"n_to": "n"}).collect() == []


@pytest.mark.parametrize("size", [5, 20_000])
def test_gapless_numbers(spark, monkeypatch, size):
    monkeypatch.setattr(numbering, "ROWS_PER_RANGE", size)
    rows = [(None if i % 3 == 0 else i % 3, i) for i in range(60)]
    df = materialize(spark.createDataFrame(rows, "g int, i int"), "numbers")
    got = {(r["g"], r["i"]): r["nth"] for r in numbering.gapless(df, ["g"], ["i"], "nth").collect()}
    assert got == {(g, i): sum(h == g and j < i for h, j in rows) for g, i in rows}
