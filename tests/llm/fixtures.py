"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id string, rest string, part string, digest string, keys string, row string, nth string, task string, component_id string, rate string, size string, split string"

WORDS = "river stone lantern quiet market window carry north silver garden letter winter harbour thread candle meadow copper signal marble orchard".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    base = sentence(rng, 60)
    long = sentence(rng, 6000)
    changed = base.split(" ")
    changed[30] = "changed"
    return [
        None, None, "", "", " \t\n", "word", "word", "Word", "two words", "two  words", "three short words", "three short words ",
        base, base, base.upper(), " ".join(changed), base + " tail", long, long, long + " end", sentence(rng, 40), sentence(rng, 40),
        "naïve café 東京 Ünïcödé", " nbsp is no blank", "emoji 🎉🎉 and \U0001F600", "tab\tand\x0bvertical\x0cfeed", "x" * 3000, "▁literal ▁mark",
    ]


def documents(spark, rows: list[str | None] | None = None, clashing: bool = True):
    """doc_ids rise with the rows; then one null id and one repeated id. With `clashing`, extra columns share names with inner ones."""
    held = texts() if rows is None else rows
    sources = ["hot", "hot", "hot", "web", None, "books"]
    data = [(i + 1, t, "en" if i % 5 else None, sources[i % 6], None if t is None else len(t)) for i, t in enumerate(held)]
    if rows is None:
        data += [(None, held[12], "en", "hot", 1), (3, held[20], None, "web", 2)]
    if not clashing:
        return spark.createDataFrame(data, DOCUMENTS)
    return spark.createDataFrame([(*d, *["clash"] * 12) for d in data], f"{DOCUMENTS}, {CLASHING}")


def empty(spark):
    return spark.createDataFrame([], f"{DOCUMENTS}, {CLASHING}")
