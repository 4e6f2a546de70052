"""Block features as array expressions, with relational forms where rows are wanted."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.binding import let
from pagelathe.functions.vocab import BYLINE_WORDS, CLASS_TOKENS, DATE_CHARACTERS, EMPTY_PAGE, NAME_WORDS, SENTENCE_MARKS, TAG_INDEX


def neighbours(blocks: Column) -> Column:
    """array<array<double>>: link and text density of the previous, this and the next block, 0 at the edges."""

    def each(held: Column) -> Column:
        at = lambda i, name: F.coalesce(F.get(held, i)[name], F.lit(0.0))
        return F.transform(held, lambda b, i: F.array(*[at(i + d, name) for d in (-1, 0, 1) for name in ("link_density", "text_density")]))

    return let(F.transform(blocks, lambda b: F.struct(b["link_density"].alias("link_density"), b["text_density"].alias("text_density"))), each)


def tag_ratio(text: Column, tagcount: Column) -> Column:
    """Bytes of text for each tag."""
    return F.octet_length(text) / F.greatest(tagcount, F.lit(1))


def forward_difference(x: Column) -> Column:
    """|mean of the next up to three values - value|; the last value meets the mean of the last two."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    def each(held: Column) -> Column:
        n = F.size(held)
        rest = lambda i: F.when(i < n - 1, F.slice(held, i + 2, F.lit(3))).otherwise(F.slice(held, F.greatest(n - 1, F.lit(1)), F.lit(2)))
        return F.transform(held, lambda v, i: let(rest(i), lambda r: F.abs(mean(r) - v)))

    return let(x, each)


def smooth(x: Column, sigma: float = 1.0, truncate: float = 4.0) -> Column:
    """Gaussian smoothing with reflected edges."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]

    def each(held: Column) -> Column:
        n = F.size(held)

        def reflect(i: Column) -> Column:
            p = F.pmod(i, 2 * n)
            return F.when(p < n, p).otherwise(2 * n - 1 - p)

        def one(_: Column, i: Column) -> Column:
            total: Column = F.lit(0.0)
            for k, w in zip(range(-radius, radius + 1), weights, strict=True):
                total = total + F.get(held, reflect(i + k)) * F.lit(w)
            return total

        return F.transform(held, one)

    return let(x, each)


def ratios(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: tag_ratio(b["text"], b["tagcount"]).cast("double"))


def class_flags(css_class: Column) -> Column:
    """35 flags: whether the class names hold each token."""
    return F.array(*[css_class.contains(t).cast("int") for t in CLASS_TOKENS])


def handcrafted(text: Column, css_id: Column, css_class: Column, start_tag: Column) -> Column:
    """8 numbers: name-like css, byline words, full-width slash, start tag, css length, date-like, sentence marks, length."""
    css = F.concat(F.when(css_id == "", "").otherwise(F.concat(css_id, F.lit(" "))), F.when(css_class == "", "").otherwise(F.concat(css_class, F.lit(" "))))
    return F.array(
        css.rlike(NAME_WORDS).cast("int"),
        text.rlike(BYLINE_WORDS).cast("int"),
        text.contains("／").cast("int"),
        F.array_position(F.array(*map(F.lit, TAG_INDEX)), start_tag).cast("int"),
        F.length(css),
        text.rlike(DATE_CHARACTERS).cast("int"),
        text.rlike(SENTENCE_MARKS).cast("int"),
        F.length(text),
    )


def css_features(blocks: Column, compat: bool = False) -> Column:
    """43 numbers a block; `compat` zeroes the class flags."""
    flags = (lambda b: F.array_repeat(F.lit(0), len(CLASS_TOKENS))) if compat else (lambda b: class_flags(b["css_class"]))
    return F.transform(blocks, lambda b: F.concat(flags(b), handcrafted(b["text"], b["css_id"], b["css_class"], b["start_tag"])))


def weninger(blocks: Column, sigma: float = 1.0) -> Column:
    """Smoothed tag ratio and smoothed forward difference of each block."""
    return let(ratios(blocks), lambda x: F.arrays_zip(smooth(x, sigma).alias("ratio"), smooth(forward_difference(x), sigma).alias("delta")))


def readability(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Readability score of each block, relationally.

    `rows`: key, pos, text, start_tag, link_density, ancestors array<int>, weights array<struct<node, weight>>.
    """
    rows, size = rows.drop("readability"), F.octet_length("text")
    weights = rows.select(key, F.explode("weights").alias("w")).groupBy(key, F.col("w.node").alias("node")).agg(F.max("w.weight").alias("weight"))
    gain = F.when((size > 25) & F.col("start_tag").isin("div", "p"), 1 + F.least(F.floor(size / 100), F.lit(3)))
    lines = rows.select(key, "link_density", size.alias("bytes"), gain.alias("gain"), F.posexplode("ancestors").alias("level", "node"), F.size("ancestors").alias("depth"))
    nearest = F.when(F.col("level") == F.col("depth") - 1, F.col("gain"))
    nodes = lines.groupBy(key, "node").agg(F.sum(F.col("link_density") * F.col("bytes")).alias("num"), F.sum("bytes").alias("den"), F.sum(nearest).alias("gained"))
    scored = nodes.where("gained IS NOT NULL").join(weights, [key, "node"], "left").withColumn("score", (F.coalesce("weight", F.lit(0)) + F.col("gained")) * (1 - F.col("num") / F.greatest("den", F.lit(1))))
    scored = scored.withColumn("top", F.greatest(F.max("score").over(Window.partitionBy(key)), F.lit(1.0)))
    best = rows.select(key, "pos", F.explode("ancestors").alias("node")).join(scored, [key, "node"]).groupBy(key, "pos").agg(F.greatest(F.max(F.col("score") / F.col("top")), F.lit(0.0)).alias("readability"))
    return rows.join(best, [key, "pos"], "left").withColumn("readability", F.coalesce("readability", F.lit(0.0)))


class ClusteredRatio:
    """k-means over (ratio, delta): the centre nearest the origin counts as zero; other clusters are content."""

    def __init__(self, k: int = 4, seed: int = 0) -> None:
        self.k, self.seed, self.centres = k, seed, []

    def fit(self, rows: DataFrame, ratio: str = "ratio", delta: str = "delta") -> ClusteredRatio:
        data = rows.select(array_to_vector(F.array(F.col(ratio).cast("double"), F.col(delta).cast("double"))).alias("features"))
        model = KMeans(k=self.k, maxIter=50, tol=1e-3, seed=self.seed).fit(data)
        axes = list(zip(*(c.tolist() for c in model.clusterCenters()), strict=True))
        self.centres = list(zip(*(sorted(a) for a in axes), strict=True))
        self.centres[0] = (0.0, 0.0)
        return self

    def transform(self, rows: DataFrame, ratio: str = "ratio", delta: str = "delta") -> DataFrame:
        far = F.array(*[F.pow(F.col(ratio) - x, 2) + F.pow(F.col(delta) - y, 2) for x, y in self.centres])
        cluster = F.array_position(far, F.array_min(far)) - 1
        return rows.withColumn("cluster", cluster.cast("int")).withColumn("is_content", F.col("cluster") > 0)


def standardize(rows: DataFrame, columns: list[str], out: str = "scaled") -> DataFrame:
    """Columns to zero mean and unit (sample) deviation, as one vector."""
    data = rows.withColumn("_raw", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    return StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(data).transform(data).drop("_raw")


def dense(blocks: Column) -> Column:
    """9 numbers a block for a scoring network: 6 densities, 2 smoothed ratios, readability."""
    parts = F.arrays_zip(neighbours(blocks).alias("n"), weninger(blocks).alias("w"), F.transform(blocks, lambda b: b["readability"]).alias("r"))
    return F.transform(parts, lambda z: F.concat(z["n"], F.array(z["w"]["ratio"], z["w"]["delta"], z["r"])))


def readability_of(blocks: Column) -> Column:
    """Readability of each block of the tree engine, which it computes in the row."""
    return F.transform(blocks, lambda b: b["readability"])


def network_inputs(pages: DataFrame, compat: bool = False, key: str = "page_id", with_meta: bool = False) -> DataFrame:
    """key, (meta, _error,) blocks, f_dense (9 numbers a block) and f_css (43), of at least three blocks a page.

    Blocks come from the tree engine. Pages of one or two blocks are padded with their first and last,
    pages without any (or that cannot be parsed) get the three blocks of EMPTY_PAGE.
    """
    from pagelathe.functions import tree, walk
    from pagelathe.operators.blocks import link_density, text_density
    from pagelathe.operators.decode import pad
    from pagelathe.operators.dom import BLOCK, parse_pages

    rows = parse_pages(pages, key=key, with_meta=with_meta).select(key, *(("meta", "_error") if with_meta else ()), "dom_blocks")
    none = [b | {"weights": [{"node": n, "weight": w} for n, w in b["weights"]]} for b in walk.blocks(tree.parse(EMPTY_PAGE))]
    held = F.when(F.coalesce(F.size("dom_blocks"), F.lit(0)) > 0, F.col("dom_blocks")).otherwise(F.from_json(F.lit(json.dumps(none)), f"array<{BLOCK}>"))
    rows = rows.withColumn("blocks", pad(F.transform(held, lambda b: b.withField("link_density", link_density(b["text"])).withField("text_density", text_density(b["text"]))))).drop("dom_blocks")
    return rows.withColumn("f_dense", dense(F.col("blocks"))).withColumn("f_css", F.transform(css_features(F.col("blocks"), compat), lambda x: F.transform(x, lambda v: v.cast("double"))))


class AuthorFeatures:
    """Author features of block rows: 9 handcrafted numbers and the principal components of two TF-IDF vectors.

    Rows need page, pos, text, css_id, css_class, start_tag, link_density and text_density. Hashed words
    bound the vectors, so the components' covariance has a fixed size.
    """

    def __init__(self, components: int = 10, hashes: int = 128, key: str = "page_id") -> None:
        self.components, self.hashes, self.key, self.model = components, hashes, key, None

    def _numbers(self, rows: DataFrame) -> DataFrame:
        css = F.concat_ws(" ", F.nullif("css_id", F.lit("")), F.nullif("css_class", F.lit("")))
        n = F.count(F.lit(1)).over(Window.partitionBy(self.key))
        named = F.col("_css").rlike(NAME_WORDS).cast("double")
        numbers = F.array(
            F.col("_css").contains("author").cast("double"), F.array_position(F.array(*map(F.lit, TAG_INDEX)), F.col("start_tag")).cast("double"), F.length("_css").cast("double"),
            F.length("text").cast("double"), F.lit(0.0), named, F.col("link_density") / F.col("text_density"), F.col("pos") / F.col("_n"), F.col("_n").cast("double"),
        )
        made = rows.withColumn("_css", css).withColumn("_n", n).withColumn("handcrafted", numbers).drop("_n")
        return made.withColumn("_css_words", F.split("_css", r"[^a-z0-9]+")).withColumn("_text_words", F.split(F.lower("text"), r"(?U)[\W_]+"))

    def fit(self, rows: DataFrame) -> AuthorFeatures:
        stages = [HashingTF(inputCol=f"_{c}_words", outputCol=f"_{c}_tf", numFeatures=self.hashes) for c in ("css", "text")]
        stages += [IDF(inputCol=f"_{c}_tf", outputCol=f"_{c}_idf") for c in ("css", "text")]
        stages += [VectorAssembler(inputCols=["_css_idf", "_text_idf"], outputCol="_words"), PCA(k=self.components, inputCol="_words", outputCol="_parts")]
        self.model = Pipeline(stages=stages).fit(self._numbers(rows))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add `author_features`: handcrafted numbers, then components."""
        made = self.model.transform(self._numbers(rows)).withColumn("author_features", F.concat("handcrafted", vector_to_array("_parts")))
        return made.select(*rows.columns, "author_features")


FEATURES: dict[str, Callable[[Column], Column]] = {"css": css_features, "kohlschuetter": neighbours, "weninger": weninger, "readability": readability_of}


def feature(name: str) -> Callable[[Column], Column] | ClusteredRatio:
    """The array expression of a feature set by name; `clustered_weninger` is a model to fit on rows.

    `readability` needs blocks of the tree engine.
    """
    if name == "clustered_weninger":
        return ClusteredRatio()
    if name not in FEATURES:
        raise ValueError(f"unknown feature {name!r}; known: {', '.join(sorted([*FEATURES, "clustered_weninger"]))}")
    return FEATURES[name]


def with_features(pages: DataFrame, names: tuple[str, ...] = ("kohlschuetter", "weninger", "css")) -> DataFrame:
    """Add one array column per feature set, aligned with `blocks`."""
    for name in names:
        pages = pages.withColumn(f"f_{name}", feature(name)(F.col("blocks")))
    return pages
