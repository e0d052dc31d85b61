"""Mixing sources to target weights by a time-varying curriculum.

Each source has a token target and a weight schedule over training time t in [0, 1]: its share of the demand
at t is target * (1 + ramp * (2 t - 1)), so the demand up to t is target * (t + ramp * (t^2 - t)). Documents of a source
stand in a fixed pseudo-random order; the place where a document's middle word falls in the cumulative supply, through
the inverse of the cumulative demand, is its training position. The mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_names

#: Weights by order of the source's name, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Schedules by order of the source's name, repeating: later in training, level, earlier.
RAMPS = (0.5, 0.0, -0.5)
#: Documents that share a slice of a source's order, on average.
SLICE_ROWS = 64


def n_words(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, ramps=RAMPS) -> DataFrame:
    """source, source_size, target, ramp from (source, source_size), one row a source.

    Targets are min(most * size, level * weight), the level being such that they add up to share * all sizes: sources are
    taken in order of the level at which they reach their limit, and the level follows from running sums. One row per source is
    ordered in one task here; a source's documents never are.
    """
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).select("source", "source_size", pick([float(w) for w in weights]).alias("w"), pick([float(r) for r in ramps]).alias("ramp"))
    full = ranked.withColumn("limit", most * F.col("source_size")).withColumn("at", F.col("limit") / F.col("w"))
    by_level = Window.orderBy("at", F.col("source").asc_nulls_last())
    every = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    capped = full.withColumn("level", level)
    # up to the first source that isn't limited, all are; from there on, that source's level holds
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "source", "level"))).over(every)
    return capped.withColumn("first", first).select("source", "source_size", F.coalesce(F.least("limit", F.col("first.level") * F.col("w")), F.col("limit")).alias("target"), "ramp")


def position(supply: Column, target: Column, ramp: Column) -> Column:
    """The training time in [0, 1] at which the cumulative demand of a source reaches supply."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), supply / target))
    root = (ramp - 1.0 + F.sqrt((1.0 - ramp) * (1.0 - ramp) + 4.0 * ramp * x)) / (2.0 * ramp)
    return F.when(target <= 0, F.lit(0.0)).when(ramp == 0, x).otherwise(root)


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, ramps=RAMPS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per row of docs: doc_id, t1, t2 (hashes of the text), source, size, source_size, target, copies, taken, positions (one a copy).

    Each source's documents are taken whole times in the order of md5(doc_id): as often as its target holds all of
    them, and once more those whose middle word falls below what is left, so that taken words are within half a document of
    the target. Null doc_ids sort by a hash of the text; rows that repeat a doc_id are ordered by size, then by a hash of the text. Texts without
    words are never taken. Other columns are not read. An empty table gives an empty one.

    A source's running sum is built from sums of slices of its order, so that no task holds all rows of a source.
    """
    docs = docs.select("doc_id", *text_names("text"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", F.lit("null"), "t1", "t2")).cast("binary"))
    docs = docs.withColumn("key", key)
    # slices are the first hexadecimal digits of the key; more digits for more rows in the largest source
    digits = F.greatest(F.lit(0), F.least(F.lit(12), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / slice_rows)) / 4))).cast("int")
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("digits", digits)
    goal = targets(totals.select("source", "source_size"), weights, share, most, ramps)
    plan = goal.join(totals.select("source", "digits").withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    named = docs.join(plan.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("slice", F.substr("key", F.lit(1), F.col("digits")))
    # running sums in two steps: of runs of slices in a source, and of slices in a run
    run = F.substr("slice", F.lit(1), F.floor(F.length("slice") / 2).cast("int"))
    slices = named.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("run", run)
    runs = slices.groupBy("source", "run").agg(F.sum("words").alias("words"))
    runs = runs.select(F.col("source").alias("__r"), F.col("run").alias("__n"), (F.sum("words").over(Window.partitionBy("source").orderBy("run")) - F.col("words")).alias("before"))
    within_run = F.sum("words").over(Window.partitionBy("source", "run").orderBy("slice")) - F.col("words")
    start = slices.withColumn("ahead", within_run).join(runs, F.col("source").eqNullSafe(F.col("__r")) & (F.col("run") == F.col("__n"))).select(F.col("source").alias("__s"), F.col("slice").alias("__p"), (F.col("before") + F.col("ahead")).alias("start"))
    placed = named.join(start, F.col("source").eqNullSafe(F.col("__s")) & (F.col("slice") == F.col("__p"))).drop("__s", "__p")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "t1", "t2").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(within) - F.col("size") / 2.0
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    copies = F.when((F.col("size") == 0) | (F.col("source_size") == 0), F.lit(0)).otherwise(whole + F.when(F.col("middle") < rest, 1).otherwise(0)).cast("int")
    out = placed.withColumn("middle", middle).withColumn("copies", copies)
    times = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: position(F.col("middle") + (k - 1) * F.col("source_size"), F.col("target"), F.col("ramp")))
    return out.select("doc_id", "t1", "t2", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")).alias("positions"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, copy (1 or 2) and position, range-sorted by position.

    Rows that repeat both doc_id and text are mixed once each, at the places of the first of them. Columns copy and position of docs are replaced.
    """
    places = mixture(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).agg(F.min(F.when(F.col("copies") > 0, F.col("positions"))).alias("__at")).where("__at is not null")
    t1, t2 = text_names("text")
    docs = docs.drop("copy", "position")
    taken = docs.join(places, docs["doc_id"].eqNullSafe(F.col("__id")) & (t1 == F.col("__t1")) & (t2 == F.col("__t2"))).select(*docs.columns, "__at")
    rows = taken.select(*[c for c in taken.columns if c != "__at"], F.posexplode("__at").alias("copy", "position")).withColumn("copy", F.col("copy") + 1)
    return rows.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
