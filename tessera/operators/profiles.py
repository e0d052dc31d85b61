"""n-gram profiles and the entropies of their blocks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import gram_counts, ngrams

#: Characters that are counted at once.
AT_ONCE = 1 << 22


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than there are cores, as a single small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(codes: list[int], texts: list[str], n: int, most: int = AT_ONCE, places: bool = False):
    """Texts with their codes, like codes together, in lists of some most characters; longer texts are cut so that each n-gram is in one part.

    With places, the place of each part's text comes third.
    """
    own, parts, at, held = [], [], [], 0
    for k in sorted(range(len(codes)), key=codes.__getitem__):
        for low in range(0, max(1, len(texts[k]) - n + 1), most):
            own.append(codes[k])
            parts.append(texts[k][low : low + most + n - 1])
            at.append(k)
            held += len(parts[-1])
            if held >= most:
                yield (own, parts, at) if places else (own, parts)
                own, parts, at, held = [], [], [], 0
    if parts:
        yield (own, parts, at) if places else (own, parts)


def counted(units: DataFrame, n: int) -> DataFrame:
    """leaf, gram, c: counts of units (leaf, text), several rows for a leaf's gram that add up. A batch's texts are counted before they are rows."""
    def run(batches):
        for batch in batches:
            number: dict = {}
            codes = [number.setdefault(x, len(number)) for x in batch.column("leaf").to_pylist()]
            names = pa.array(list(number), batch.schema.field("leaf").type)
            for own, parts in slices(codes, batch.column("text").to_pylist(), n):
                least = own[0]
                leaf, gram, c = gram_counts([x - least for x in own], parts, n)
                yield pa.RecordBatch.from_arrays([names.take(pa.array([x + least for x in leaf], pa.int64())), pa.array(gram, pa.string()), pa.array(c, pa.int64())], ["leaf", "gram", "c"])

    kind = T.StructType([units.schema["leaf"], T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])
    return units.select("leaf", "text").where("text is not null").mapInArrow(run, kind)


def profile(units: DataFrame, n: int = 3) -> DataFrame:
    """leaf, gram, c: how often each n-gram stands in a leaf's units (leaf, text). No n-gram crosses units."""
    return counted(spread(units), n).groupBy("leaf", "gram").agg(F.sum("c").alias("c"))


def joined_profile(units: DataFrame, n: int = 3) -> DataFrame:
    """leaf, gram, c of each leaf's units (leaf, unit_id, text) joined by one space in the order of unit_id, without ever holding a leaf's text.

    Units without text are left out. Grams inside a unit are counted where it lies; those that hold the space between two units come from the
    last n - 1 characters before it and the first n - 1 after it, which alone are put in order.
    """
    t = spread(units.where("text <> ''"))
    inside = counted(t, n)
    if n == 1:
        edges = t.groupBy("leaf").agg((F.count("*") - 1).alias("c")).where("c > 0").select("leaf", F.lit(" ").alias("gram"), "c")
        return inside.unionByName(edges).groupBy("leaf", "gram").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("leaf").orderBy("unit_id")
    slim = t.select("leaf", "unit_id", F.right("text", F.lit(n - 1)).alias("tail"), F.left("text", F.lit(n - 1)).alias("head"))
    before = F.right(F.concat_ws(" ", *[F.lag("tail", k).over(order) for k in range(n - 1, 0, -1)]), F.lit(n - 1))
    edges = slim.select("leaf", before.alias("before"), "head", F.row_number().over(order).alias("k")).where("k > 1")
    across = edges.select("leaf", F.explode(ngrams(F.concat("before", F.lit(" "), "head"), n)).alias("gram"))
    return inside.unionByName(across.withColumn("c", F.lit(1).cast("bigint"))).groupBy("leaf", "gram").agg(F.sum("c").alias("c"))


def capped_units(units: DataFrame, cap: int) -> DataFrame:
    """Units (leaf, unit_id, text) of which the texts, joined by one space in the order of unit_id, are each leaf's first cap characters.

    Lengths alone are summed in order. A space at the very end is cut, and so is a unit of which only the space before it fits.
    """
    t = units.where("text <> ''")
    order = Window.partitionBy("leaf").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, -1)
    start = t.select("leaf", "unit_id", F.length("text").alias("n")).select("leaf", "unit_id", F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0)).alias("start")).where(F.col("start") < cap)
    return t.join(start, ["leaf", "unit_id"]).select("leaf", "unit_id", F.rtrim(F.substr("text", F.lit(1), F.least(F.length("text"), cap - F.col("start")).cast("int"))).alias("text"))


def joined_units(units: DataFrame, cap: int | None = None) -> DataFrame:
    """leaf, text: units (leaf, unit_id, text) joined by one space in the order of unit_id, cut to cap characters.

    A leaf's text is one row, for what needs it whole, such as compression; the cap is applied before texts are put together.
    """
    t = units.where("text <> ''") if cap is None else capped_units(units, cap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"]), " ")
    return t.groupBy("leaf").agg(text.alias("text"))


def equalized(texts: DataFrame) -> DataFrame:
    """Texts cut to the length of the shortest."""
    least = texts.agg(F.min(F.length("text")).alias("least"))
    return texts.crossJoin(F.broadcast(least)).withColumn("text", F.substr("text", F.lit(1), F.col("least"))).drop("least")


def vocabulary(profiles: DataFrame) -> DataFrame:
    return profiles.select("gram").distinct().orderBy("gram")


def probabilities(profiles: DataFrame) -> DataFrame:
    """profiles with p, a gram's share in its leaf. Totals are joined, so that a leaf's grams needn't meet in one task."""
    total = profiles.groupBy("leaf").agg(F.sum("c").alias("total"))
    return profiles.join(total, "leaf").withColumn("p", F.col("c") / F.col("total")).drop("total")


def sizes(profiles: DataFrame) -> DataFrame:
    """leaf, k distinct grams, n all."""
    return profiles.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("c").alias("n"))


def sparse(profiles: DataFrame, most: float = 0.3) -> DataFrame:
    """sizes with ratio k/n and whether it is over most."""
    return sizes(profiles).withColumn("ratio", F.col("k") / F.col("n")).withColumn("sparse", F.col("ratio") > most)


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: raised by recurrence to 8 or more, then its asymptotic series."""
    up = F.greatest(F.lit(0), F.ceil(8 - x)).cast("int")
    steps = F.aggregate(F.when(up > 0, F.sequence(F.lit(0), up - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / (x + i))
    y = x + up
    z = 1.0 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def grassberger_g(c: Column) -> Column:
    """psi(c) + (-1)^c / 2 * (psi((c + 1) / 2) - psi(c / 2))."""
    sign = F.when(c % 2 == 0, 1.0).otherwise(-1.0)
    return digamma(c.cast("double")) + 0.5 * sign * (digamma((c + 1) / 2.0) - digamma(c / 2.0))


def block_entropy(profiles: DataFrame, estimator: str = "plugin", by: tuple[str, ...] = ("leaf",)) -> DataFrame:
    """The columns of by, h: the entropy in bits of a leaf's blocks by plugin, mm (Miller-Madow) or grassberger.

    Sums run over how many grams have each count, so that equal counts are one term.
    """
    if estimator not in ("plugin", "mm", "grassberger"):
        raise ValueError(f"unknown estimator: {estimator}")
    of_counts = profiles.groupBy(*by, "c").agg(F.count("*").alias("m"))
    log = grassberger_g(F.col("c")) / math.log(2) if estimator == "grassberger" else F.log2(F.col("c").cast("double"))
    sums = of_counts.groupBy(*by).agg(F.sum(F.col("m") * F.col("c")).alias("__n"), F.sum("m").alias("__k"), F.sum(F.col("m") * F.col("c") * log).alias("__s"))
    h = F.log2(F.col("__n").cast("double")) - F.col("__s") / F.col("__n")
    if estimator == "mm":
        h = h + (F.col("__k") - 1) / (2 * F.col("__n") * math.log(2))
    return sums.select(*by, F.when(F.col("__n") > 0, h).otherwise(0.0).alias("h"))


def ladder(units: DataFrame, most: int = 4, estimator: str = "plugin") -> DataFrame:
    """leaf, n, h, f: block entropies and their differences f_n = h_n - h_(n-1), h_0 being 0.

    Texts are expanded once, to the longest grams, with marks after their ends; shorter grams are what those begin with.
    """
    marked = units.select("leaf", F.concat("text", F.lit("\0" * (most - 1))).alias("text")).where("text is not null")
    counts = profile(marked, most)
    begins = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.struct(n.alias("n"), F.substring("gram", F.lit(1), n).alias("gram")))
    each = counts.select("leaf", "c", F.explode(begins).alias("x")).where(~F.contains("x.gram", F.lit("\0"))).groupBy("leaf", "x.n", "x.gram").agg(F.sum("c").alias("c"))
    steps = block_entropy(each, estimator, ("leaf", "n"))
    f = F.col("h") - F.lag("h", 1, 0.0).over(Window.partitionBy("leaf").orderBy("n"))
    return steps.select("leaf", "n", "h", f.alias("f"))


def draws(key: Column, n: Column) -> Column:
    """A number below n by the first 60 bits of the key's md5: the same in every partitioning, and in any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint"), n)


def entropy_simulation(spark, k: int = 64, sizes=(128, 1024, 16384), reps: int = 200, seed: int = 0) -> DataFrame:
    """n, estimator, h: mean estimates over reps samples of n uniform symbols out of k, whose entropy is log2 k."""
    out = None
    for n in sizes:
        at = spark.range(n * reps).select(F.floor(F.col("id") / n).cast("string").alias("leaf"), draws(F.concat_ws(":", F.lit(seed), F.lit(n), "id"), F.lit(k)).cast("string").alias("gram"))
        counts = at.groupBy("leaf", "gram").agg(F.count("*").alias("c"))
        for e in ("plugin", "mm", "grassberger"):
            one = block_entropy(counts, e).agg(F.avg("h").alias("h")).select(F.lit(n).alias("n"), F.lit(e).alias("estimator"), "h")
            out = one if out is None else out.unionByName(one)
    return out


def without(profiles: DataFrame, grams: DataFrame) -> DataFrame:
    """profiles without the grams of the one column of grams; shares are of what is left."""
    return profiles.join(grams.select(F.col(grams.columns[0]).alias("gram")).distinct(), "gram", "left_anti").select("leaf", "gram", "c")


def hit_rate(profiles: DataFrame, grams: list[str]) -> DataFrame:
    """leaf, rate: the share of places whose gram is listed."""
    return profiles.groupBy("leaf").agg((F.sum(F.when(F.col("gram").isin(grams), F.col("c")).otherwise(0)) / F.sum("c")).alias("rate"))
