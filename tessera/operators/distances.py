"""Distances between leaves: tables (i, j, d) with i < j, one row for each pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ndist
from .held import held, sent
from .profiles import sizes, spread


def pairs(leaves: DataFrame) -> DataFrame:
    """All pairs i < j of the one column of leaves; the result is itself of that size."""
    one = leaves.select(F.col(leaves.columns[0]).alias("i")).distinct()
    return one.join(one.select(F.col("i").alias("j")), F.col("i") < F.col("j"))


def overlap(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """The inner self join of a leaf table on the named columns, i < j; other columns get the suffixes _i and _j."""
    rest = [c for c in left.columns if c not in (*on, "leaf")]
    a = left.select(*on, F.col("leaf").alias("i"), *[F.col(c).alias(f"{c}_i") for c in rest])
    b = right.select(*on, F.col("leaf").alias("j"), *[F.col(c).alias(f"{c}_j") for c in rest])
    return a.join(b, list(on)).where("i < j")


def half(p: Column, q: Column) -> Column:
    """A gram's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return 0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)


def js(profiles: DataFrame, alpha: float = 0.0, leaves: DataFrame | None = None) -> DataFrame:
    """Root of the Jensen-Shannon divergence of n-gram shares; 1 where two leaves share no gram or one is empty.

    A gram on one side only adds half its share. So the divergence is 1 and, over shared grams, their part less the halves: only an
    inner join on gram is needed. With alpha, shares are (c + alpha) / (n + alpha * k), k being the grams of the pair; parts of
    one-sided grams then depend on their count alone and come from a histogram of counts.
    """
    profiles = held(profiles)
    total = sent(sizes(profiles))
    every = pairs(leaves if leaves is not None else total.select("leaf"))
    if alpha == 0:
        shares = profiles.join(total.select("leaf", "n"), "leaf").select("leaf", "gram", (F.col("c") / F.col("n")).alias("p"))
        part = F.sum(half(F.col("p_i"), F.col("p_j")) - (F.col("p_i") + F.col("p_j")) / 2)
        div = overlap(shares, shares, "gram").groupBy("i", "j").agg(part.alias("s"))
        return every.join(div, ["i", "j"], "left").select("i", "j", F.sqrt(F.greatest(F.lit(0.0), 1.0 + F.coalesce("s", F.lit(0.0)))).alias("d"))
    both = overlap(profiles, profiles, "gram").select("i", "j", "c_i", "c_j")
    shared = both.groupBy("i", "j").agg(F.count("*").alias("both"))
    side = lambda x: total.select(F.col("leaf").alias(x), F.col("n").alias(f"n_{x}"), F.col("k").alias(f"k_{x}"))
    about = every.join(side("i"), "i").join(side("j"), "j").join(shared, ["i", "j"], "left")
    about = sent(about.withColumn("k", F.col("k_i") + F.col("k_j") - F.coalesce("both", F.lit(0))).select("i", "j", "n_i", "n_j", "k"))
    term = lambda a, b: half((a + alpha) / (F.col("n_i") + alpha * F.col("k")), (b + alpha) / (F.col("n_j") + alpha * F.col("k")))
    none = F.lit(0.0)
    inner = both.join(about, ["i", "j"]).groupBy("i", "j").agg(F.sum(term(F.col("c_i"), F.col("c_j")) - term(F.col("c_i"), none) - term(none, F.col("c_j"))).alias("s"))
    histogram = held(profiles.groupBy("leaf", "c").agg(F.count("*").alias("m")))
    left = histogram.join(about, F.col("leaf") == F.col("i")).select("i", "j", (F.col("m") * term(F.col("c"), none)).alias("s"))
    right = histogram.join(about, F.col("leaf") == F.col("j")).select("i", "j", (F.col("m") * term(none, F.col("c"))).alias("s"))
    div = inner.unionByName(left).unionByName(right).groupBy("i", "j").agg(F.sum("s").alias("s"))
    return every.join(div, ["i", "j"], "left").select("i", "j", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("s", F.lit(1.0)))).alias("d"))


def jaccard(profiles: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """1 less the share of common grams, space apart; 0 for two empty sets. Unigram profiles give the distance of alphabets."""
    profiles = held(profiles)
    sets = profiles.where("gram <> ' '").select("leaf", "gram")
    k = sent(sets.groupBy("leaf").agg(F.count("*").alias("k")))
    both = overlap(sets, sets, "gram").groupBy("i", "j").agg(F.count("*").alias("both"))
    every = pairs(leaves if leaves is not None else profiles.select("leaf"))
    of = lambda x: k.select(F.col("leaf").alias(x), F.col("k").alias(f"k_{x}"))
    t = every.join(of("i"), "i", "left").join(of("j"), "j", "left").join(both, ["i", "j"], "left").fillna(0)
    union = F.col("k_i") + F.col("k_j") - F.col("both")
    return t.select("i", "j", F.when(union == 0, 0.0).otherwise(1 - F.col("both") / union).alias("d"))


def perplexity(profiles: DataFrame, alpha: float = 0.1, symbols: int | None = None) -> DataFrame:
    """Mean excess cross entropy, both ways, of character models of order n - 1 made from n-gram profiles; not below 0.

    A model gives (c + alpha) / (total + alpha * v) for a context it knows, else 1 / v; v is the number of distinct characters of all
    profiles (2 at least). Grams whose context a model doesn't know aren't joined: they are what is left of the leaf's total.
    """
    profiles = held(profiles)
    grams = profiles.select("leaf", "gram", "c", F.expr("substring(gram, 1, length(gram) - 1)").alias("ctx"))
    v = F.lit(symbols) if symbols else None
    if v is None:
        chars = profiles.select("gram").distinct().select(F.explode(F.split("gram", "")).alias("ch")).where("ch <> ''").agg(F.greatest(F.countDistinct("ch"), F.lit(2)).alias("v"))
    model = grams.groupBy(F.col("leaf").alias("m"), "ctx").agg(F.sum("c").alias("total"))
    own = grams.select(F.col("leaf").alias("m"), "gram", F.col("c").alias("seen"))
    total = sent(grams.groupBy("leaf").agg(F.sum("c").alias("n")))
    scored = grams.join(model, "ctx").join(own, ["m", "gram"], "left")
    scored = scored.crossJoin(F.broadcast(chars)) if v is None else scored.withColumn("v", v)
    p = (F.coalesce("seen", F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("v"))
    known = scored.groupBy("leaf", "m").agg(F.sum(-F.col("c") * F.log2(p)).alias("bits"), F.sum("c").alias("known"))
    every = total.crossJoin(total.select(F.col("leaf").alias("m")))  # the result has a row for each pair itself
    every = every.crossJoin(F.broadcast(chars)) if v is None else every.withColumn("v", v)
    ce = every.join(known, ["leaf", "m"], "left").fillna(0, ["bits", "known"])
    ce = ce.select("leaf", "m", ((F.col("bits") + (F.col("n") - F.col("known")) * F.log2(F.col("v").cast("double"))) / F.col("n")).alias("ce"))
    ce = held(ce)
    itself = sent(ce.where("leaf = m").select("leaf", F.col("ce").alias("own")))
    excess = ce.join(itself, "leaf").where("leaf <> m").select(F.least("leaf", "m").alias("i"), F.greatest("leaf", "m").alias("j"), (F.col("ce") - F.col("own")).alias("x"))
    return excess.groupBy("i", "j").agg(F.greatest(F.lit(0.0), F.sum("x") / 2).alias("d"))


def word_lists(words: DataFrame) -> DataFrame:
    """Mean normalised Levenshtein distance over shared concepts of (leaf, concept, form); 1 where none is shared."""
    both = overlap(words, words, "concept").groupBy("i", "j").agg(F.avg(ndist(F.col("form_i"), F.col("form_j"))).alias("d"), F.count("*").alias("shared"))
    return pairs(words.select("leaf")).join(both, ["i", "j"], "left").select("i", "j", F.coalesce("d", F.lit(1.0)).alias("d"), F.coalesce("shared", F.lit(0)).alias("shared"))


def cognates(classes: DataFrame) -> DataFrame:
    """1 less the share of equal classes among shared concepts of (leaf, concept, cogid); 1 where none is shared."""
    both = overlap(classes, classes, "concept").groupBy("i", "j").agg((1 - F.avg(F.when(F.col("cogid_i") == F.col("cogid_j"), 1.0).otherwise(0.0))).alias("d"), F.count("*").alias("shared"))
    return pairs(classes.select("leaf")).join(both, ["i", "j"], "left").select("i", "j", F.coalesce("d", F.lit(1.0)).alias("d"), F.coalesce("shared", F.lit(0)).alias("shared"))


def shared_summary(dist: DataFrame) -> DataFrame:
    """mean, least: how many concepts pairs (i, j, shared) share."""
    return dist.agg(F.avg("shared").alias("mean"), F.min("shared").alias("least"))


def blocks(groups: DataFrame) -> DataFrame:
    """0 for leaves of one group, 1 for others, from (leaf, group)."""
    g = lambda x: groups.select(F.col("leaf").alias(x), F.col("group").alias(f"g{x}"))
    return pairs(groups.select("leaf")).join(g("i"), "i").join(g("j"), "j").select("i", "j", F.when(F.col("gi").eqNullSafe(F.col("gj")), 0.0).otherwise(1.0).alias("d"))


SEPARATOR = b"\x01"


def ncd(texts: DataFrame, variant: str = "v2", cap_bytes: int | None = 30_000) -> DataFrame:
    """Normalised compression distance (gzip, level 9) of (leaf, text).

    basic: (c(xy) - min) / max in one order. fixed and v2: both orders' mean, with a separating byte, not below 0; fixed takes off the mean of
    all leaves' distances to themselves, v2 half of each of the pair's.
    """
    import gzip

    if variant not in ("basic", "fixed", "v2"):
        raise ValueError(f"unknown variant: {variant}")
    data = texts.select("leaf", (F.substring(F.encode("text", "UTF-8"), 1, cap_bytes) if cap_bytes else F.encode("text", "UTF-8")).alias("b"))

    @F.pandas_udf("bigint")
    def size(s: pd.Series) -> pd.Series:
        return s.map(lambda b: len(gzip.compress(b, 9, mtime=0)))

    mid = F.lit(b"" if variant == "basic" else SEPARATOR)
    own = spread(data).withColumn("c", size("b")).withColumn("cc", size(F.concat("b", mid, "b"))).withColumn("self", (F.col("cc") - F.col("c")) / F.col("c"))
    own = sent(own)
    # pairs of names are dealt out first, so that every core compresses; texts join them where they are
    every = pairs(own.select("leaf")).repartition(4 * data.sparkSession.sparkContext.defaultParallelism, "i", "j")
    a, b = (own.select(F.col("leaf").alias(x), F.col("b").alias(f"b{x}"), F.col("c").alias(f"c{x}"), F.col("self").alias(f"self{x}")) for x in "ij")
    both = every.join(a, "i").join(b, "j")
    low, high = F.least("ci", "cj"), F.greatest("ci", "cj")
    one = (size(F.concat("bi", mid, "bj")) - low) / high
    if variant == "basic":
        return both.select("i", "j", one.alias("d"))
    mean = (one + (size(F.concat("bj", mid, "bi")) - low) / high) / 2
    if variant == "v2":
        return both.select("i", "j", F.greatest(F.lit(0.0), mean - (F.col("selfi") + F.col("selfj")) / 2).alias("d"))
    return both.crossJoin(F.broadcast(own.agg(F.avg("self").alias("floor")))).select("i", "j", F.greatest(F.lit(0.0), mean - F.col("floor")).alias("d"))


def symmetric(dist: DataFrame) -> DataFrame:
    """Both (i, j) and (j, i)."""
    return dist.select("i", "j", "d").unionByName(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def subset(dist: DataFrame, leaves: DataFrame) -> DataFrame:
    """The pairs of which both leaves are in the one column of leaves."""
    name = leaves.columns[0]
    out = dist
    for side in ("i", "j"):
        out = out.join(leaves.select(F.col(name).alias(side)).distinct(), side, "left_semi")
    return out.select(*dist.columns)
