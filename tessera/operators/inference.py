"""Permutation tests and bootstraps. Draws follow from hashes of (seed, replicate, place), so that results don't depend on partitions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_counts, ngrams
from .distances import half, overlap, symmetric
from .held import held, sent
from .profiles import draws, slices, spread
from .trees import build, splits


def permutations(leaves: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """rep, leaf, other: rep 0 leaves all of the one column of leaves in place, reps 1 to reps permute them.

    A permutation is the order of md5(seed:rep:leaf), so that it is the same in every partitioning and in any engine that has md5.
    """
    name = leaves.select(F.col(leaves.columns[0]).alias("leaf")).distinct()
    each = name.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    key = F.when(F.col("rep") > 0, F.md5(F.concat_ws(":", F.lit(seed), "rep", "leaf").cast("binary"))).otherwise("")
    at = lambda *by: F.row_number().over(Window.partitionBy("rep").orderBy(*by))
    placed = each.withColumn("key", key).select("rep", "leaf", at("leaf").alias("place"), at("key", "leaf").alias("drawn"))
    other = placed.select("rep", F.col("drawn").alias("place"), F.col("leaf").alias("other"))
    return placed.select("rep", "place", "leaf").join(other, ["rep", "place"]).select(F.col("rep").cast("bigint").alias("rep"), "leaf", "other")


def _permuted(d2: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, i, j, y: the second matrix with permuted leaves, i < j."""
    d2 = held(d2)
    perm = permutations(d2.select("i").union(d2.select("j")), reps, seed)  # the matrix's own leaves
    full = sent(symmetric(d2).withColumnRenamed("d", "y"))
    a, b = (perm.select("rep", F.col("leaf").alias(x), F.col("other").alias(f"o{x}")) for x in "ij")
    return a.join(b, "rep").where("i < j").join(full.select(F.col("i").alias("oi"), F.col("j").alias("oj"), "y"), ["oi", "oj"]).select("rep", "i", "j", "y")


def _verdict(per_rep: DataFrame, reps: int) -> DataFrame:
    r0 = per_rep.where("rep = 0").select(F.col("r").alias("r0"))
    t = per_rep.where("rep > 0").crossJoin(F.broadcast(r0))
    return t.agg(F.max("r0").alias("r"), ((F.sum(F.when(F.abs("r") >= F.abs("r0") - 1e-12, 1).otherwise(0)) + 1) / (reps + 1)).alias("p"))


def mantel(d1: DataFrame, d2: DataFrame, perms: int = 999, seed: int = 0) -> DataFrame:
    """r and its two-sided p: (1 + permutations with |r| as large) / (perms + 1)."""
    t = _permuted(d2, perms, seed).join(sent(d1.select("i", "j", F.col("d").alias("x"))), ["i", "j"])
    return _verdict(t.groupBy("rep").agg(F.corr("x", "y").alias("r")), perms)


def partial_mantel(d1: DataFrame, d2: DataFrame, control: DataFrame, perms: int = 999, seed: int = 0) -> DataFrame:
    """The same of the residuals on control; those of d1 are fixed, those of d2 are taken anew for each permutation."""
    z = control.select("i", "j", F.col("d").alias("z"))
    x = d1.select("i", "j", F.col("d").alias("x")).join(z, ["i", "j"])
    fit = x.agg(F.regr_slope("x", "z").alias("b"), F.regr_intercept("x", "z").alias("a"))
    left = x.crossJoin(F.broadcast(fit)).select("i", "j", "z", (F.col("x") - F.col("a") - F.col("b") * F.col("z")).alias("ex"))
    t = _permuted(d2, perms, seed).join(sent(left), ["i", "j"])
    own = t.groupBy("rep").agg(F.regr_slope("y", "z").alias("b"), F.regr_intercept("y", "z").alias("a"))
    r = t.join(sent(own), "rep").groupBy("rep").agg(F.corr("ex", F.col("y") - F.col("a") - F.col("b") * F.col("z")).alias("r"))
    return _verdict(r, perms)


#: Hexadecimal digits of the slices in which units are numbered.
SLICE_DIGITS = 3


def numbered(units: DataFrame) -> DataFrame:
    """unit_id, k: the distinct unit_ids, numbered from 0 in the order of md5(unit_id), slice by slice, so that no task orders them all."""
    each = units.select("unit_id").distinct().withColumn("key", F.md5(F.col("unit_id").cast("string").cast("binary")))
    each = each.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    size = each.groupBy("slice").agg(F.count("*").alias("n"))
    start = size.select("slice", (F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))  # at most 16^SLICE_DIGITS rows
    place = F.row_number().over(Window.partitionBy("slice").orderBy("key", "unit_id")) - 1
    return each.join(F.broadcast(start), "slice").select("unit_id", (F.col("start") + place).alias("k"))


def unit_weights(units: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """rep, unit_id, w: how often each unit_id of units, of any type, is drawn in a resample of as many units as there are.

    Draw k of a replicate takes the unit whose number is md5(seed:rep:k) modulo the number of units.
    """
    known = numbered(units)
    number = known.agg(F.count("*").alias("n"))
    each = known.select("k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).crossJoin(F.broadcast(number))  # one row
    drawn = each.select(F.col("rep").cast("bigint").alias("rep"), draws(F.concat_ws(":", F.lit(seed), "rep", "k"), F.col("n")).alias("k")).groupBy("rep", "k").agg(F.count("*").alias("w"))
    return drawn.join(known, "k").select("rep", "unit_id", "w")


def block_replicates(units: DataFrame, reps: int, n: int = 3, seed: int = 0) -> DataFrame:
    """rep, i, j, d: JS distances of resamples of whole units (leaf, unit_id, text); all leaves share each resample.

    Units are counted once; a replicate is a weighted sum of their counts.
    """
    weights = held(unit_weights(units, reps, seed))
    some = [range(low, min(reps, low + AT_ONCE)) for low in range(0, reps, AT_ONCE)]
    out = [_js_wide(_block_sums(units, weights, x, n), _block_totals(units, weights, x, n), x) for x in some]
    return reduce(DataFrame.unionByName, out)


#: Replicates that one pass over the units adds up.
AT_ONCE = 50
#: Characters of units for each partition of their sums, at least one partition a core.
CHARS_A_PART = 1 << 22
#: Replicates and leaves on either side of the pairs that one task compares.
REPS_A_TASK, LEAVES_A_TASK = 5, 512


def _block_totals(units: DataFrame, weights: DataFrame, some: range, n: int) -> dict[str, list[int]]:
    """The number of n-grams of each leaf in each of some replicates, by the lengths of its units; leaves without any are left out."""
    size = units.select("leaf", "unit_id", (F.length("text") - (n - 1)).cast("bigint").alias("n")).where("n > 0").groupBy("leaf", "unit_id").agg(F.sum("n").alias("n"))
    t = size.join(weights.where(F.col("rep").between(some[0], some[-1])), "unit_id").groupBy("leaf", "rep").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    total: dict[str, list[int]] = {}
    for r in t.collect():  # a row for each leaf and replicate; the result has one for each two leaves and replicate
        total.setdefault(r["leaf"], [0] * len(some))[r["rep"] - some[0]] = r["n"]
    return total


def _block_sums(units: DataFrame, weights: DataFrame, some: range, n: int) -> DataFrame:
    """leaf, gram, c: the counts of each of some replicates, as an array. Units are counted with their weights before they are rows."""
    wide = weights.where(F.col("rep").between(some[0], some[-1])).groupBy("unit_id").agg(F.array(*[F.sum(F.when(F.col("rep") == r, F.col("w")).otherwise(0)) for r in some]).alias("w"))

    def run(batches):
        for batch in batches:
            number: dict = {}
            codes = [number.setdefault(x, len(number)) for x in batch.column("leaf").to_pylist()]
            names, w = pa.array(list(number), pa.string()), batch.column("w").flatten().to_numpy().reshape(-1, len(some))
            for own, parts, at in slices(codes, batch.column("text").to_pylist(), n, places=True):
                leaf, gram, c = gram_counts([x - own[0] for x in own], parts, n, w[at])
                if len(gram):
                    c = pa.FixedSizeListArray.from_arrays(pa.array(c.reshape(-1)), len(some)).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array([x + own[0] for x in leaf], pa.int64())), pa.array(gram, pa.string()), c], ["leaf", "gram", "c"])

    rows = spread(units.select("leaf", "unit_id", "text").where("text is not null")).join(wide, "unit_id").select("leaf", "text", "w").mapInArrow(run, "leaf string, gram string, c array<bigint>")
    chars = units.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).head()[0]
    parts = max(units.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS_A_PART))
    sums = rows.repartition(parts, "leaf", "gram").groupBy("leaf", "gram").agg(*[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(len(some))])
    return sums.select("leaf", "gram", F.array(*[f"c{k}" for k in range(len(some))]).alias("c"))


def _js_wide(sums: DataFrame, total: dict[str, list[int]], some: range) -> DataFrame:
    """rep, i, j, d: JS of the replicates of sums (leaf, gram, c).

    A task has REPS_A_TASK replicates and two blocks of LEAVES_A_TASK leaves. It reads their counts gram by gram and holds the sums of its pairs alone.
    """
    spark, most, width = sums.sparkSession, REPS_A_TASK, LEAVES_A_TASK
    names = sorted(total)
    n = np.array([total[x] for x in names], np.float64).reshape(-1, len(some))
    blocks = max(1, -(-len(names) // width))
    known = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(names)], "leaf string, k int"))  # leaves, of which all pairs are the result
    own = F.floor(F.col("k") / width).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.named_struct(F.lit("a"), F.least(b, own), F.lit("b"), F.greatest(b, own)))
    cut = F.array(*[F.struct(F.lit(k).alias("part"), F.slice("c", k + 1, most).alias("c")) for k in range(0, len(some), most)])
    rows = sums.join(known, "leaf").select("gram", "k", F.explode(cut).alias("x"), tiles.alias("tiles")).where(F.exists("x.c", lambda c: c > 0))
    rows = rows.select(F.explode("tiles").alias("t"), "x.part", "gram", "k", "x.c").select("t.a", "t.b", "part", "gram", "k", "c")
    groups = blocks * (blocks + 1) // 2 * -(-len(some) // most)

    def run(batches):
        def found(task, acc):
            a, b, part = task
            for r in range(acc.shape[2]):
                there = n[:, part + r] > 0
                i, j = np.nonzero(there[a * width : (a + 1) * width, None] & there[None, b * width : (b + 1) * width])
                i, j = (i[i < j], j[i < j]) if a == b else (i, j)
                d = np.sqrt(np.maximum(0.0, 1.0 + acc[i, j, r]))
                for low in range(0, len(d), 1 << 16):
                    x = slice(low, low + (1 << 16))
                    ij = [every.take(pa.array(k[x] + block * width)) for k, block in ((i, a), (j, b))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d[x]), some[part + r])), *ij, pa.array(d[x])], ["rep", "i", "j", "d"])

        def added(task, acc, k, c):
            a, b, part = task
            size = n[k, part : part + c.shape[1]]
            p = np.divide(c, size, out=np.zeros(c.shape), where=size > 0)
            if a == b:
                left, right = np.triu_indices(len(k), 1)
            else:
                left, right = (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(k // width == a), np.flatnonzero(k // width == b), indexing="ij"))
            for low in range(0, len(left), 1 << 16):
                x, y = left[low : low + (1 << 16)], right[low : low + (1 << 16)]
                u, v = p[x], p[y]
                m = (u + v) / 2
                part_of = 0.5 * u * np.log2(u / m) + 0.5 * v * np.log2(v / m) - m
                acc[k[x] - a * width, k[y] - b * width] += np.where((u > 0) & (v > 0), part_of, 0.0)

        every, task, acc, rest = pa.array(names, pa.string()), None, None, None
        with np.errstate(divide="ignore", invalid="ignore"):
            for batch in chain(batches, [None]):
                table = pa.Table.from_batches(([rest] if rest is not None else []) + ([batch] if batch is not None else [])).combine_chunks() if rest is not None or batch is not None else None
                if table is None or not table.num_rows:
                    continue
                table = table.to_batches()[0]
                a, b, part, k = (table.column(x).to_numpy() for x in ("a", "b", "part", "k"))
                gram = table.column("gram").dictionary_encode().indices.to_numpy()
                start = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(part) != 0) | (np.diff(gram) != 0)]))
                ends = [*start[1:], table.num_rows]
                last = len(start) - (batch is not None)  # the last gram may go on in the next batch
                c = table.column("c").flatten().to_numpy()
                offset = table.column("c").offsets.to_numpy() - table.column("c").offsets[0].as_py()
                for low, high in zip(start[:last], ends[:last], strict=True):
                    now = int(a[low]), int(b[low]), int(part[low])
                    if now != task:
                        if task is not None:
                            yield from found(task, acc)
                        task, acc = now, np.zeros((min(width, len(names) - now[0] * width), min(width, len(names) - now[1] * width), min(most, len(some) - now[2])))
                    added(task, acc, k[low:high], c[offset[low] : offset[high]].reshape(high - low, -1))
                rest = table.slice(start[-1]) if batch is not None else None
            if task is not None:
                yield from found(task, acc)

    dealt = rows.repartition(groups, "a", "b", "part").sortWithinPartitions("a", "b", "part", "gram", "k")
    return dealt.mapInArrow(run, "rep bigint, i string, j string, d double")


def _js_by(profiles: DataFrame) -> DataFrame:
    """rep, i, j, d: JS of every replicate's profiles (rep, leaf, gram, c) at once, joined on replicate and gram."""
    profiles = held(profiles)
    total = sent(profiles.groupBy("rep", "leaf").agg(F.sum("c").alias("n")))
    a, b = (total.select("rep", F.col("leaf").alias(x)) for x in "ij")
    shares = profiles.join(total, ["rep", "leaf"]).select("rep", "leaf", "gram", (F.col("c") / F.col("n")).alias("p"))
    div = overlap(shares, shares, "rep", "gram").groupBy("rep", "i", "j").agg(F.sum(half(F.col("p_i"), F.col("p_j")) - (F.col("p_i") + F.col("p_j")) / 2).alias("s"))
    every = a.join(b, "rep").where("i < j").join(div, ["rep", "i", "j"], "left")
    return every.select("rep", "i", "j", F.sqrt(F.greatest(F.lit(0.0), 1.0 + F.coalesce("s", F.lit(0.0)))).alias("d"))


def token_draw(profiles: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """rep, leaf, gram, c: multinomial resamples of each leaf's n-grams, one task's work being one leaf in one replicate."""
    import hashlib

    import numpy as np
    import pandas as pd

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gram")
        name, n = g["leaf"].iloc[0], int(g["c"].sum())
        key = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())  # names alike in their letters differ
        c = np.random.default_rng([seed, key, int(g["rep"].iloc[0])]).multinomial(n, g["c"].to_numpy() / n)
        return g.assign(c=c)[c > 0][["rep", "leaf", "gram", "c"]]

    each = profiles.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))).alias("rep"), "leaf", "gram", "c")
    return each.groupBy("rep", "leaf").applyInPandas(draw, "rep bigint, leaf string, gram string, c bigint")


def token_replicates(profiles: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """rep, i, j, d: JS distances of multinomial resamples of each leaf's n-grams."""
    return _js_by(token_draw(profiles, reps, seed))


def leaf_replicates(units: DataFrame, leaf: str, reps: int, n: int = 3, seed: int = 0) -> DataFrame:
    """rep, gram, c: resamples of one leaf's units by the draws that all leaves of units share."""
    own = units.where(F.col("leaf") == leaf).select("unit_id", F.explode(ngrams(F.col("text"), n)).alias("gram")).groupBy("unit_id", "gram").agg(F.count("*").alias("c"))
    return own.join(unit_weights(units, reps, seed), "unit_id").groupBy("rep", "gram").agg(F.sum(F.col("c") * F.col("w")).alias("c"))


def support(reference: DataFrame, replicates: DataFrame, reps: int, method: str = "upgma") -> DataFrame:
    """split, support: the share of replicate trees with each split of the reference tree of distances, larger splits first."""
    ref = splits(build(reference, method)).select("split").distinct()
    trees = build(replicates, method, "rep").withColumnRenamed("rep", "tree")
    n = splits(trees).groupBy("split").agg(F.count("*").alias("n"))
    return ref.join(n, "split", "left").select("split", (F.coalesce("n", F.lit(0)) / reps).alias("support")).orderBy(-F.size("split"), "split")


def interval(values: DataFrame, name: str) -> DataFrame:
    """lo, med, hi of a column: percentiles 2.5, 50 and 97.5 by linear interpolation."""
    q = values.agg(F.percentile(name, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(*[F.col("q")[k].alias(x) for k, x in enumerate(("lo", "med", "hi"))])


def purity_interval(replicates: DataFrame, groups: DataFrame) -> DataFrame:
    """lo, med, hi of the replicates' purities."""
    g = lambda x: groups.select(F.col("leaf").alias(x), F.col("group").alias(f"g{x}"))
    both = replicates.select("rep", "i", "j", "d").unionByName(replicates.select("rep", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    near = both.groupBy("rep", "i").agg(F.min(F.struct(F.round("d", 9).alias("d"), "j")).alias("x")).select("rep", "i", "x.j").join(g("i"), "i").join(g("j"), "j")
    return interval(near.groupBy("rep").agg(F.avg(F.when(F.col("gi") == F.col("gj"), 1.0).otherwise(0.0)).alias("p")), "p")


def rf_replicates(replicates: DataFrame, gold: DataFrame, method: str = "upgma") -> DataFrame:
    """rep, rf: the Robinson-Foulds distance of each replicate's tree from the splits of gold, over the number of both trees' splits."""
    trees = build(replicates, method, "rep").withColumnRenamed("rep", "tree")
    own = splits(trees)
    want = gold.select("split").distinct()
    shared = own.join(want.withColumn("in", F.lit(1)), "split", "left").groupBy("tree").agg(F.count("*").alias("n"), F.count("in").alias("both"))
    t = trees.select("tree").join(shared, "tree", "left").fillna(0).crossJoin(F.broadcast(want.agg(F.count("*").alias("m"))))  # one row
    return t.select(F.col("tree").alias("rep"), F.coalesce((F.col("n") + F.col("m") - 2 * F.col("both")) / F.nullif(F.col("n") + F.col("m"), F.lit(0)), F.lit(0.0)).alias("rf"))


def rf_interval(replicates: DataFrame, gold: DataFrame, method: str = "upgma") -> DataFrame:
    """lo, med, hi of the replicates' Robinson-Foulds distances from gold."""
    return interval(rf_replicates(replicates, gold, method), "rf")
