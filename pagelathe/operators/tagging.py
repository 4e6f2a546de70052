"""Names by labels of single characters: features for a tagger, best labels, and names from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.binding import let
from pagelathe.functions.vocab import NO_NAME_CHARACTERS

#: Rows of an embedding table up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def characters(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_features(text: Column) -> Column:
    """array<struct>: case, n-grams, class, place and neighbours of each character."""

    def one(chars: Column) -> Column:
        n = F.size(chars)
        joined = lambda a, b: F.lower(F.array_join(F.slice(chars, F.greatest(a, F.lit(0)) + 1, F.least(b, n) - F.greatest(a, F.lit(0))), ""))
        upper = lambda c: F.coalesce((F.upper(c) == c) & (F.lower(c) != c), F.lit(False))

        def features(c: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(chars, i - 1)), F.get(chars, i + 1)
            return F.struct(
                F.lower(c).alias("lower"), upper(c).alias("is_upper"), upper(c).alias("is_title"), joined(i - 1, i + 2).alias("trigram"), joined(i - 1, i + 1).alias("bigram"), joined(i, i + 3).alias("next_three"),
                joined(i, i + 5).alias("next_five"), c.rlike(r"(?U)^\s$").alias("is_space"), F.lit(NO_NAME_CHARACTERS).contains(c).alias("is_symbol"), c.rlike(r"(?U)^\d$").alias("is_digit"), i.alias("place"),
                F.lower(before).alias("before"), upper(before).alias("before_is_upper"), F.lower(after).alias("after"), upper(after).alias("after_is_upper"),
            )

        return F.transform(chars, features)

    return F.when(text.isNotNull(), let(characters(text), one))


def with_embeddings(rows: DataFrame, table: DataFrame, key: str, text: str = "text", unknown: str = "UNK") -> DataFrame:
    """key, place, char, vector: each character's vector of `table` (word, vector), else that of `unknown`."""
    chars = rows.select(key, F.posexplode(characters(F.col(text))).alias("place", "char"))
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    other = table.where(F.col("word") == unknown).agg(F.first("vector").alias("_other"))
    found = chars.join(table.hint("broadcast" if small else "merge"), F.col("char") == F.col("word"), "left")
    return found.join(F.broadcast(other)).select(key, "place", "char", F.coalesce("vector", "_other").alias("vector"))


def best_labels(marginals: Column) -> Column:
    """The likeliest label of each map of label to probability."""
    ranked = lambda m: F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    return F.transform(marginals, lambda m: ranked(m)["label"])


def names_from_labels(labels: Column, text: Column) -> Column:
    """Names: B begins one, I goes on with it, other labels end it. Marks are taken off, empty names left out."""
    empty = F.array().cast("array<string>")
    step = F.transform(labels, lambda label, i: F.struct(label.alias("label"), F.get(characters(text), i).alias("char")))

    def add(acc: Column, x: Column) -> Column:
        begins = (x["label"] == "B") | ((x["label"] == "I") & ~acc["inside"])
        last = F.size(acc["names"])
        longer = F.concat(F.slice(acc["names"], F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.get(acc["names"], last - 1), x["char"])))
        names = F.when(begins, F.concat(acc["names"], F.array(x["char"]))).when(x["label"] == "I", longer).otherwise(acc["names"])
        return F.struct(names.alias("names"), x["label"].isin("B", "I").alias("inside"))

    runs = F.aggregate(step, F.struct(empty.alias("names"), F.lit(False).alias("inside")), add, lambda acc: acc["names"])
    return F.filter(F.transform(runs, lambda n: F.trim(F.translate(n, NO_NAME_CHARACTERS, ""))), lambda n: n != "")
