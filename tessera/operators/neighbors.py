"""Nearest neighbours and how pure they are by a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distances import subset, symmetric
from .held import held, sent

TOLERANCE = 1e-9


def nearest(dist: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """i, j, d, ties: each leaf's nearest leaf, the first by name among those within tolerance, and how many those are."""
    both = symmetric(held(dist))
    least = both.groupBy("i").agg(F.min("d").alias("least"))
    near = both.join(least, "i").where(F.col("d") <= F.col("least") + tolerance)
    return near.groupBy("i").agg(F.min("j").alias("j"), F.first("least").alias("d"), F.count("*").alias("ties"))


def judged(near: DataFrame, groups: DataFrame) -> DataFrame:
    """near with hit: 1 if a leaf's nearest leaf is of its group, else 0; leaves without a row in groups (leaf, group) go."""
    g = lambda x: groups.select(F.col("leaf").alias(x), F.col("group").alias(f"g{x}"))
    return near.join(g("i"), "i").join(g("j"), "j").withColumn("hit", F.when(F.col("gi") == F.col("gj"), 1.0).otherwise(0.0))


def purity(dist: DataFrame, groups: DataFrame, tie: str = "first") -> DataFrame:
    """purity, n, n_ties over leaves with (leaf, group): the share whose nearest leaf is of their group.

    Ties: first takes the first by name; miss counts a leaf with ties as wrong; drop leaves it out.
    """
    if tie not in ("first", "miss", "drop"):
        raise ValueError(f"unknown tie policy: {tie}")
    hit = {"first": F.col("hit"), "miss": F.when(F.col("ties") > 1, 0.0).otherwise(F.col("hit")), "drop": F.when(F.col("ties") == 1, F.col("hit"))}[tie]
    return judged(nearest(dist), groups).agg(F.avg(hit).alias("purity"), F.count(hit).alias("n"), F.count_if(F.col("ties") > 1).alias("n_ties"))


def diagnostics(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """purity, purity_tiemiss, n_ties, n and chance as one row, from one search for neighbours."""
    near = judged(nearest(dist), groups).agg(F.avg("hit").alias("purity"), F.avg(F.when(F.col("ties") > 1, 0.0).otherwise(F.col("hit"))).alias("purity_tiemiss"), F.count_if(F.col("ties") > 1).alias("n_ties"), F.count("*").alias("n"))
    return near.crossJoin(F.broadcast(chance_floor(groups)))  # two rows of one each


def chance_floor(groups: DataFrame) -> DataFrame:
    """chance: the purity of random neighbours, sum of m (m - 1) over n (n - 1); 0 for fewer than 2 leaves."""
    m = groups.groupBy("group").agg(F.count("*").alias("m"))
    n = F.sum("m")
    return m.agg(F.coalesce(F.when(n > 1, F.sum(F.col("m") * (F.col("m") - 1)) / (n * (n - 1))), F.lit(0.0)).alias("chance"))


def subset_purity(dist: DataFrame, groups: DataFrame, members: DataFrame, tie: str = "first") -> DataFrame:
    return purity(subset(dist, members), groups, tie)


def bias(dist: DataFrame, sizes: DataFrame) -> DataFrame:
    """Correlations of distance with the larger of the pair's k, and with their difference, from sizes (leaf, k)."""
    known = sent(sizes.select("leaf", "k"))
    k = lambda x: known.select(F.col("leaf").alias(x), F.col("k").alias(f"k{x}"))
    t = dist.join(k("i"), "i").join(k("j"), "j")
    return t.agg(F.corr("d", F.greatest("ki", "kj").cast("double")).alias("r_max"), F.corr("d", F.abs(F.col("ki") - F.col("kj")).cast("double")).alias("r_diff"))


def spread_of(dist: DataFrame) -> DataFrame:
    """Percentiles 2.5, 50 and 97.5 of d with linear interpolation."""
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return dist.agg(q.alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("lo", "med", "hi"))])


def first_units(units: DataFrame, n: int) -> DataFrame:
    """The first n units of each leaf by unit_id."""
    return units.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy("unit_id"))).where(F.col("rank") <= n).drop("rank")


def common_units(units: DataFrame) -> DataFrame:
    """unit_ids that every leaf has, as text in text order."""
    leaves = units.agg(F.countDistinct("leaf").alias("all"))
    return units.groupBy(F.col("unit_id").cast("string").alias("unit_id")).agg(F.countDistinct("leaf").alias("have")).crossJoin(F.broadcast(leaves)).where("have = all").select("unit_id").orderBy("unit_id")


def best_doculect(words: DataFrame, language: str, least: int = 20) -> DataFrame:
    """For each language the leaf with most concepts, first by name; those with fewer than least are out."""
    n = words.groupBy(language, "leaf").agg(F.countDistinct("concept").alias("concepts")).where(F.col("concepts") >= least)
    best = n.groupBy(language).agg(F.min(F.struct((-F.col("concepts")).alias("less"), "leaf")).alias("b"))
    return best.select(language, "b.leaf", (-F.col("b.less")).alias("concepts"))


def dominant(rows: DataFrame, key: str, label: str) -> DataFrame:
    """For each key its most frequent label, first by name, and that label's share."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(label).alias("label"))).alias("b"), F.sum("n").alias("all"))
    return best.select(key, F.col("b.label").alias("label"), (-F.col("b.less") / F.col("all")).alias("share"))


def in_target(rows: DataFrame, key: str, hit, flag_below: float = 70.0) -> DataFrame:
    """For each key the percentage of rows for which the condition hit holds, and whether that is below flag_below."""
    out = rows.groupBy(key).agg((F.avg(F.when(hit, 1.0).otherwise(0.0)) * 100).alias("percent"), F.count("*").alias("n"))
    return out.withColumn("flagged", F.col("percent") < flag_below)


def preferred(rows: DataFrame, key: str, choice: str, order: list[str]) -> DataFrame:
    """For each key the row whose choice stands first in order, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(choice)), F.lit(0)), F.lit(len(order) + 1))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(rank, choice))).where("rank = 1").drop("rank")
