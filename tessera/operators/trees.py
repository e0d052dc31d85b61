"""Trees from distances, their splits, and distances between trees. Trees are small; each one is built inside one task."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_of(rows) -> tuple[list[str], list[list[float]]]:
    """Leaves by name and the full matrix of a pandas table (i, j, d)."""
    names = sorted({*rows["i"], *rows["j"]})
    at = {x: k for k, x in enumerate(names)}
    d = [[0.0] * len(names) for _ in names]
    for i, j, x in zip(rows["i"], rows["j"], rows["d"], strict=True):
        d[at[i]][at[j]] = d[at[j]][at[i]] = float(x)
    return names, d


def average_linkage(d: list[list[float]]) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of each merge; new clusters are numbered from n on. Ties go to the first pair."""
    n = len(d)
    size, live, dist = dict.fromkeys(range(n), 1), list(range(n)), {(a, b): d[a][b] for a in range(n) for b in range(a + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        h, a, b = min((dist[x, y], x, y) for i, x in enumerate(live) for y in live[i + 1 :])
        live = [x for x in live if x not in (a, b)]
        for x in live:
            dist[x, new] = (size[a] * dist[min(a, x), max(a, x)] + size[b] * dist[min(b, x), max(b, x)]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        live.append(new)
        out.append((a, b, h, size[new]))
    return out


def linkage_newick(links: list[tuple], names: list[str]) -> str:
    part = list(names)
    for a, b, *_ in links:
        part.append(f"({part[a]},{part[b]})")
    return part[-1] + ";"


def clusters_of(links: list[tuple], n: int, k: int) -> list[int]:
    """The cluster number, from 1 in order of first leaf, of each leaf when the last k - 1 merges are undone."""
    member = {i: [i] for i in range(n)}
    for step, (a, b, *_) in enumerate(links[: max(0, n - k)]):
        member[n + step] = member.pop(a) + member.pop(b)
    out = [0] * n
    for number, leaves in enumerate(sorted(member.values(), key=min), 1):
        for x in leaves:
            out[x] = number
    return out


def cophenetic(links: list[tuple], n: int) -> list[list[float]]:
    """The height at which two leaves first meet."""
    member, out = {i: [i] for i in range(n)}, [[0.0] * n for _ in range(n)]
    for step, (a, b, h, _) in enumerate(links):
        left, right = member.pop(a), member.pop(b)
        for x in left:
            for y in right:
                out[x][y] = out[y][x] = h
        member[n + step] = left + right
    return out


def joined_newick(d: list[list[float]], names: list[str]) -> str:
    """Neighbour joining: lengths of 6 decimals, none below 0; ties go to the first pair."""
    part, live = dict(enumerate(names)), list(range(len(names)))
    dist = {(a, b): d[a][b] for a in live for b in live}
    if len(live) == 1:
        return part[0] + ";"
    while len(live) > 2:
        m = len(live)
        row = {a: sum(dist[a, b] for b in live) for a in live}
        _, a, b = min(((m - 2) * dist[x, y] - row[x] - row[y], x, y) for i, x in enumerate(live) for y in live[i + 1 :])
        la = dist[a, b] / 2 + (row[a] - row[b]) / (2 * (m - 2))
        new = max(part) + 1
        part[new] = f"({part[a]}:{max(0.0, la):.6f},{part[b]}:{max(0.0, dist[a, b] - la):.6f})"
        live = [x for x in live if x not in (a, b)]
        for x in live:
            dist[x, new] = dist[new, x] = (dist[a, x] + dist[b, x] - dist[a, b]) / 2
        dist[new, new] = 0.0
        live.append(new)
    a, b = live
    return f"({part[a]}:{max(0.0, dist[a, b]):.6f},{part[b]}:0.000000);"


def build(dist: DataFrame, method: str = "upgma", by: str | None = None) -> DataFrame:
    """newick of each group of by (or of all pairs): upgma without lengths, or nj with."""
    if method not in ("upgma", "nj"):
        raise ValueError(f"unknown tree method: {method}")
    key = by or "tree"
    rows = dist if by else dist.withColumn("tree", F.lit("all"))
    kind = rows.schema[key].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        names, d = matrix_of(group)
        newick = linkage_newick(average_linkage(d), names) if method == "upgma" else joined_newick(d, names)
        return pd.DataFrame({key: [group[key].iloc[0]], "newick": [newick]})

    return rows.select(key, "i", "j", "d").groupBy(key).applyInPandas(one, f"{key} {kind}, newick string")


def linkage(dist: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merges (step, left_id, right_id, height, size), the clusters (leaf, cluster) of k, and cophenetic pairs (i, j, d, c)."""
    rows = dist.select("i", "j", "d").withColumn("tree", F.lit("all")).groupBy("tree")

    def merges(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(s, *x) for s, x in enumerate(average_linkage(matrix_of(g)[1]))], columns=["step", "left_id", "right_id", "height", "size"])

    def flat(g: pd.DataFrame) -> pd.DataFrame:
        names, d = matrix_of(g)
        return pd.DataFrame({"leaf": names, "cluster": clusters_of(average_linkage(d), len(names), k)})

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        names, d = matrix_of(g)
        c = cophenetic(average_linkage(d), len(names))
        return pd.DataFrame([(names[a], names[b], d[a][b], c[a][b]) for a in range(len(names)) for b in range(a + 1, len(names))], columns=["i", "j", "d", "c"])

    return rows.applyInPandas(merges, "step int, left_id int, right_id int, height double, size int"), rows.applyInPandas(flat, "leaf string, cluster int"), rows.applyInPandas(meet, "i string, j string, d double, c double")


def layout(merges: DataFrame) -> DataFrame:
    """step, x_left, x_right, y_left, y_right, y of each merge of linkage(): a dendrogram's bars, leaves being 10 apart from 5 on, as they hang."""

    def place(g: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(g[["step", "left_id", "right_id", "height"]].itertuples(index=False))
        n = len(rows) + 1
        order, x, y = [n + len(rows) - 1], {}, dict.fromkeys(range(n), 0.0)
        while any(k >= n for k in order):
            order = [c for k in order for c in ((rows[k - n].left_id, rows[k - n].right_id) if k >= n else (k,))]
        x = {leaf: 5.0 + 10.0 * k for k, leaf in enumerate(order)}
        out = []
        for step, a, b, h in rows:
            x[n + step], y[n + step] = (x[a] + x[b]) / 2, h
            out.append((step, x[a], x[b], y[a], y[b], h))
        return pd.DataFrame(out, columns=["step", "x_left", "x_right", "y_left", "y_right", "y"])

    return merges.withColumn("tree", F.lit("all")).groupBy("tree").applyInPandas(place, "step int, x_left double, x_right double, y_left double, y_right double, y double")


def cophenetic_corr(dist: DataFrame) -> DataFrame:
    return linkage(dist)[2].agg(F.corr("d", "c").alias("r"))


def parsed(newick: str) -> list[frozenset[str]]:
    """The leaf sets of all inner nodes, the root's last. Labels keep their underscores; lengths and inner labels are skipped."""
    import re

    stack: list[list[set]] = []
    sets, closed = [], False
    for token in re.findall(r"[(),;]|'(?:[^']|'')*'|[^(),;']+", newick):
        if token == "(":
            stack.append([])
        elif token == ")":
            own = set().union(*stack.pop())
            sets.append(frozenset(own))
            if stack:
                stack[-1].append(own)
        elif token not in ",;" and not closed:  # after a bracket comes an inner node's label or length
            name = token.strip("'") if token[0] == "'" else token.split(":")[0].strip()
            if name and stack:
                stack[-1].append({name})
            closed = True  # after a quoted name comes its length
            continue
        closed = token == ")" or token not in "(,;"
    return sets


def splits_of(newick: str) -> set[frozenset[str]]:
    """The smaller sides (of two equal ones the one with the first leaf) of all splits with 2 leaves or more on each side."""
    sets = parsed(newick)
    every = max(sets, key=len, default=frozenset())
    return {canonical(s, every) for s in sets if 2 <= len(s) <= len(every) - 2}


def canonical(side: frozenset, every: frozenset) -> frozenset:
    other = every - side
    return min(side, other, key=lambda x: (len(x), sorted(x)))


def splits(trees: DataFrame) -> DataFrame:
    """tree, split (sorted array of leaves) of (tree, newick)."""
    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(sorted(x) for x in splits_of(t)))

    return trees.select("tree", F.explode(run("newick")).alias("split"))


def internal_bipartitions(splits: DataFrame) -> DataFrame:
    """n: how many different splits of 2 leaves or more on each side there are, a basal bifurcation's two branches being one."""
    return splits.select("split").distinct().agg(F.count("*").alias("n"))


def smaller_sides(sides: DataFrame, every: DataFrame, *by: str) -> DataFrame:
    """The columns of by, split: the smaller sides (of equal ones the first) of the splits that side cuts off from every, one row; each once, trivial ones left out."""
    t = sides.crossJoin(F.broadcast(every)).withColumn("other", F.array_sort(F.array_except("every", "side")))
    t = t.where((F.size("side") >= 2) & (F.size("other") >= 2))
    smaller = F.when(F.size("side") < F.size("other"), F.col("side")).when(F.size("side") > F.size("other"), F.col("other")).otherwise(F.least("side", "other"))
    return t.select(*by, smaller.alias("split")).distinct()


def lineage_splits(lineages: DataFrame) -> DataFrame:
    """split: the smaller sides of the splits that the ancestors of (leaf, depth, ancestor) imply, each once; depth 0 is the leaf itself."""
    every = lineages.agg(F.array_sort(F.collect_set("leaf")).alias("every"))
    sides = lineages.where("depth > 0").groupBy("ancestor").agg(F.array_sort(F.collect_set("leaf")).alias("side")).select("side")
    return smaller_sides(sides, every)


def lineage_newick(lineages: DataFrame, labels: dict[str, str] | None = None) -> str:
    """The nested tree of (leaf, depth, ancestor), ancestors of one child collapsing; labels: names to give leaves. One path a leaf is held."""
    rows = lineages.where("depth > 0").groupBy("leaf").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"])).alias("path")).collect()
    alone = {r["leaf"] for r in lineages.select("leaf").distinct().collect()}
    paths = {name: [] for name in alone} | {r["leaf"]: r["path"] for r in rows}

    def nest(part: dict[str, list[str]], depth: int) -> str:
        groups: dict[str, dict] = {}
        out = []
        for leaf, path in sorted(part.items()):
            if len(path) == depth:
                out.append((labels or {}).get(leaf, leaf))
            else:
                groups.setdefault(path[depth], {})[leaf] = path
        out += [nest(g, depth + 1) for _, g in sorted(groups.items())]
        return out[0] if len(out) == 1 else f"({','.join(out)})"

    return nest(paths, 0) + ";"


def gold_splits(groups: DataFrame, *levels: str) -> DataFrame:
    """split: the smaller sides of the splits that the levels of a taxonomy (leaf, *levels) imply, each once.

    Groups of one leaf, and of all leaves but one, imply none.
    """
    every = groups.agg(F.array_sort(F.collect_set("leaf")).alias("every"))
    sides = None
    for k in range(len(levels)):
        one = groups.groupBy(*levels[: k + 1]).agg(F.array_sort(F.collect_set("leaf")).alias("side")).select("side")
        sides = one if sides is None else sides.unionByName(one)
    return smaller_sides(sides, every)


def containing_clade(groups: DataFrame, clades: DataFrame) -> DataFrame:
    """group, clade, size, exact: the smallest of the clades (split) that holds all leaves of a group (leaf, group); null if none does.

    exact says that the clade has no other leaves. Of clades of one size, the first by its leaves counts.
    """
    members = groups.groupBy("group").agg(F.collect_set("leaf").alias("members"))
    # a clade that holds a group holds its first leaf: an equi-join finds the candidates
    held = clades.select("split", F.explode("split").alias("first"))
    t = members.withColumn("first", F.array_min("members")).join(held, "first").where(F.size(F.array_except("members", "split")) == 0)
    best = t.groupBy("group").agg(F.min(F.struct(F.size("split").alias("size"), "split")).alias("x"))
    return members.join(best, "group", "left").select("group", F.col("x.split").alias("clade"), F.col("x.size").alias("size"), (F.col("x.size") == F.size("members")).alias("exact"))


def gold_newick(rows: list[tuple[str, ...]]) -> str:
    """The nested tree of (leaf, family, genus, subgenus) rows; levels of one child collapse; a missing family is NA, others _."""
    def nest(part: list[tuple[str, ...]], depth: int) -> str:
        if depth == len(part[0]):
            names = [r[0] for r in part]
            return names[0] if len(names) == 1 else f"({','.join(names)})"
        groups: dict[str, list] = {}
        for r in part:
            groups.setdefault(r[depth] or ("NA" if depth == 1 else "_"), []).append(r)
        children = [nest(groups[g], depth + 1) for g in sorted(groups)]
        return children[0] if len(children) == 1 else f"({','.join(children)})"

    return nest(rows, 1) + ";"


def rf(a: DataFrame, b: DataFrame, legacy_leaves: int | None = None) -> DataFrame:
    """rf: splits in one of two tables and not the other, over the number of both (0 if none), or over 2 (leaves - 3)."""
    one, two = a.select("split").distinct(), b.select("split").distinct()
    differ = one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count("*").alias("differ"))
    number = one.unionByName(two).agg(F.count("*").alias("all"))
    below = F.lit(2 * (legacy_leaves - 3)) if legacy_leaves else F.col("all")
    return differ.crossJoin(number).select(F.coalesce(F.col("differ") / F.nullif(below, F.lit(0)), F.lit(0.0)).alias("rf"))


def random_newick(names: list[str], seed: int) -> str:
    """A random binary tree: two random subtrees join until one is left."""
    rng, part = random.Random(seed), list(names)
    while len(part) > 1:
        a = part.pop(rng.randrange(len(part)))
        b = part.pop(rng.randrange(len(part)))
        part.append(f"({a},{b})")
    return part[0] + ";"


def rf_of(a: str, b: str) -> float:
    x, y = splits_of(a), splits_of(b)
    return len(x ^ y) / (len(x) + len(y)) if x or y else 0.0


def random_null(spark, names: list[str], gold: str, n: int = 500, seed: int = 0) -> DataFrame:
    """rep, rf of n random trees against a gold tree, over all executors."""
    def run(batches):
        for g in batches:
            yield pd.DataFrame({"rep": g["id"], "rf": [rf_of(random_newick(names, seed * 1_000_003 + int(r)), gold) for r in g["id"]]})

    return spark.range(n).mapInPandas(run, "rep bigint, rf double")


def label_shuffle_null(tree: DataFrame, gold: DataFrame, leaves: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """rep, rf of a tree's splits, its leaves shuffled n times, against the splits of gold, over 2 (leaves - 3)."""
    from .inference import permutations

    drawn = permutations(leaves, n, seed).where("rep > 0")
    numbered = tree.select("split").distinct().select(F.array_join("split", "|").alias("id"), "split")
    sides = numbered.select("id", F.explode("split").alias("leaf")).join(drawn, "leaf").groupBy("rep", "id").agg(F.array_sort(F.collect_list("other")).alias("side"))
    every = leaves.agg(F.array_sort(F.collect_set(leaves.columns[0])).alias("every"))
    other = smaller_sides(sides, every, "rep")
    want = gold.select("split").distinct()
    shared = other.join(want.withColumn("in", F.lit(1)), "split", "left").groupBy("rep").agg(F.count("*").alias("n"), F.count("in").alias("both"))
    size = want.agg(F.count("*").alias("m")).crossJoin(every.select(F.size("every").alias("leaves")))  # one row
    return shared.crossJoin(F.broadcast(size)).select("rep", ((F.col("n") + F.col("m") - 2 * F.col("both")) / (2 * (F.col("leaves") - 3))).alias("rf"))


def tree_comparison(spark, inferred: str, gold: str, n_null: int = 300, seed: int = 0) -> DataFrame:
    """rf_triple() and the quartet distance of an imported tree, such as a sampler's summary tree, against gold, as one row."""
    from .quartets import gqd, quartets

    names = sorted(max(parsed(gold), key=len))
    table = lambda t: spark.createDataFrame([(sorted(x),) for x in splits_of(t)], "split array<string>")
    leaves = spark.createDataFrame([(x,) for x in names], "leaf string")
    return rf_triple(spark, inferred, gold, names, n_null, seed).crossJoin(gqd(quartets(leaves), table(inferred), table(gold)))


def null_summary(null: DataFrame, n: int) -> DataFrame:
    """p05, p50, p95 by place in the sorted values (not interpolated), and the least."""
    s = F.array_sort(F.collect_list("rf"))
    return null.agg(s.alias("s")).select(*[F.col("s")[min(n - 1, int(q * n))].alias(name) for q, name in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))], F.col("s")[0].alias("least"))


def resolved(newick_splits: set[frozenset], names: list[str], seed: int) -> set[frozenset]:
    """The splits of a random binary tree that has all the given splits."""
    rng = random.Random(seed)
    every = frozenset(names)
    rooted = [s if names[0] not in s else every - s for s in newick_splits]
    children: dict[frozenset, list[frozenset]] = {}
    nodes = sorted([*rooted, *(frozenset([x]) for x in names)], key=lambda s: (len(s), sorted(s)))
    for k, s in enumerate(nodes):
        children.setdefault(next((t for t in nodes[k + 1 :] if s < t), every), []).append(s)
    out = set()
    for part in children.values():
        part = list(part)
        while len(part) > 2:
            a = part.pop(rng.randrange(len(part)))
            b = part.pop(rng.randrange(len(part)))
            part.append(a | b)
            out.add(a | b)
    return newick_splits | {canonical(s, every) for s in out if 2 <= len(s) <= len(every) - 2}


def rf_triple(spark, inferred: str, gold: str, names: list[str], n_null: int = 300, seed: int = 0) -> DataFrame:
    """observed, floor (median of 5 random resolutions of gold), null_p50 and rescaled (null where the span is about 0)."""
    got, want = splits_of(inferred), splits_of(gold)
    observed = rf_of(inferred, gold)
    floors = sorted(len(r ^ want) / max(1, len(r) + len(want)) for r in (resolved(want, names, seed + k) for k in range(5)))
    null = null_summary(random_null(spark, names, gold, n_null, seed), n_null)
    span = F.col("p50") - floors[2]
    return null.select(F.lit(observed).alias("observed"), F.lit(floors[2]).alias("floor"), F.col("p50").alias("null_p50"), F.when(F.abs(span) > 1e-9, (observed - floors[2]) / span).alias("rescaled"), F.lit(len(got)).alias("n_splits"))
