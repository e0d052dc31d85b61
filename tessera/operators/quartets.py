"""Quartets of leaves: topologies from splits, quartet distance, and the delta score."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .held import sent


#: Quartets drawn where there are too many to take all: for the quartet distance, and for the delta score.
GQD_SAMPLE, DELTA_SAMPLE = 400_000, 200_000


def quartets(leaves: DataFrame, max_full: int = 70, n_sample: int = GQD_SAMPLE, seed: int = 0) -> DataFrame:
    """a < b < c < e, approx: all quartets of up to max_full leaves, else a seeded sample with repeats, of which approx is true."""
    spark = leaves.sparkSession
    one = leaves.select(F.col(leaves.columns[0]).alias("leaf")).distinct()
    if one.count() <= max_full:
        col = lambda n: one.select(F.col("leaf").alias(n))
        q = col("a").join(F.broadcast(col("b")), F.col("a") < F.col("b")).join(F.broadcast(col("c")), F.col("b") < F.col("c")).join(F.broadcast(col("e")), F.col("c") < F.col("e"))
        return q.withColumn("approx", F.lit(False))
    names = sorted(r["leaf"] for r in one.collect())
    rng = random.Random(seed)
    return spark.createDataFrame([tuple(sorted(rng.sample(names, 4))) for _ in range(n_sample)], "a string, b string, c string, e string").withColumn("approx", F.lit(True))


def topology(quads: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """quads with the leaf that stands with a by the first split that cuts a quartet in two pairs; null if none does."""
    side = lambda x: F.array_contains("split", F.col(x)).cast("int")
    t = quads.select("a", "b", "c", "e").distinct().join(sent(splits.select("split")), (side("a") + side("b") + side("c") + side("e")) == 2)
    partner = F.when(side("a") == side("b"), F.col("b")).when(side("a") == side("c"), F.col("c")).otherwise(F.col("e"))
    found = t.groupBy("a", "b", "c", "e").agg(F.min(partner).alias(name))
    return quads.join(found, ["a", "b", "c", "e"], "left")


def gqd(quads: DataFrame, inferred: DataFrame, gold: DataFrame) -> DataFrame:
    """gqd, resolved_in_gold, n, approx (whether quads are a sample): among quartets that gold resolves, the share that inferred resolves otherwise or not at all."""
    t = topology(topology(quads, gold, "g"), inferred, "x")
    wrong = F.when(F.col("g").isNotNull(), F.when(F.col("x").eqNullSafe(F.col("g")), 0.0).otherwise(1.0))
    return t.agg(F.coalesce(F.avg(wrong), F.lit(0.0)).alias("gqd"), F.count("g").alias("resolved_in_gold"), F.count("*").alias("n"), F.coalesce(F.bool_or("approx"), F.lit(False)).alias("approx"))


def delta(quads: DataFrame, dist: DataFrame) -> DataFrame:
    """delta: the mean over quartets of (largest - middle) / (largest - least) of the three pair sums; 0 where those are equal."""
    t, known = quads, sent(dist.select("i", "j", "d"))
    for x, y in combinations("abce", 2):
        t = t.join(known.select(F.col("i").alias(x), F.col("j").alias(y), F.col("d").alias(x + y)), [x, y])
    s = F.array_sort(F.array(F.col("ab") + F.col("ce"), F.col("ac") + F.col("be"), F.col("ae") + F.col("bc")))
    span = s[2] - s[0]
    return t.agg(F.avg(F.when(span <= 1e-12, 0.0).otherwise((s[2] - s[1]) / span)).alias("delta"), F.count("*").alias("n"))


def clade_delta(dist: DataFrame, clades: DataFrame) -> DataFrame:
    """clade, delta, n of (clade, leaf) with 4 members or more, each over its own quartets."""
    m = lambda x: clades.select("clade", F.col("leaf").alias(x))
    q = m("a").join(m("b"), "clade").where("a < b").join(m("c"), "clade").where("b < c").join(m("e"), "clade").where("c < e")
    known = sent(dist.select("i", "j", "d"))
    for x, y in combinations("abce", 2):
        q = q.join(known.select(F.col("i").alias(x), F.col("j").alias(y), F.col("d").alias(x + y)), [x, y])
    s = F.array_sort(F.array(F.col("ab") + F.col("ce"), F.col("ac") + F.col("be"), F.col("ae") + F.col("bc")))
    span = s[2] - s[0]
    return q.groupBy("clade").agg(F.avg(F.when(span <= 1e-12, 0.0).otherwise((s[2] - s[1]) / span)).alias("delta"), F.count("*").alias("n"))
