"""Cognate classes from word lists, and binary characters from classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ndist


def single_linkage(words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """leaf, concept, cogid of (leaf, concept, form): forms of a concept that hang together by distances below threshold.

    cogid is the least form's place among the concept's classes, from 0. Distances are Spark's; a concept's distinct forms,
    which are few, are put together in one task.
    """
    import pandas as pd

    forms = words.select("concept", "form").distinct()
    near = forms.join(forms.withColumnRenamed("form", "other"), "concept").where((F.col("form") <= F.col("other")) & ((F.col("form") == F.col("other")) | (ndist(F.col("form"), F.col("other")) < threshold)))

    def classes(g: pd.DataFrame) -> pd.DataFrame:
        root = {f: f for f in {*g["form"], *g["other"]}}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in zip(g["form"], g["other"], strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        order = {r: k for k, r in enumerate(sorted({find(f) for f in root}))}
        return pd.DataFrame({"concept": g["concept"].iloc[0], "form": list(root), "cogid": [order[find(f)] for f in root]})

    kind = words.schema["concept"].dataType.simpleString()
    found = near.groupBy("concept").applyInPandas(classes, f"concept {kind}, form string, cogid int")
    return words.join(found, ["concept", "form"]).select("leaf", "concept", "cogid")


def word_rows(words: DataFrame) -> DataFrame:
    """leaf, concept, position, token, ipa: the rows of a word list (leaf, concept, tokens) for cognate detection, one a token, from position 0;
    ipa is the word's tokens joined by a space. Empty tokens, and words without any, are left out."""
    t = words.withColumn("tokens", F.filter("tokens", lambda x: x.isNotNull() & (x != ""))).where(F.size("tokens") > 0)
    return t.select("leaf", F.col("concept").cast("string").alias("concept"), F.posexplode("tokens").alias("position", "token"), F.array_join("tokens", " ").alias("ipa"))


def informative(classes: DataFrame, least: int = 2) -> DataFrame:
    """concept, cogid, size of classes with `least` leaves or more, in concepts with as many."""
    concept = classes.groupBy("concept").agg(F.countDistinct("leaf").alias("n")).where(F.col("n") >= least).select("concept")
    return classes.groupBy("concept", "cogid").agg(F.countDistinct("leaf").alias("size")).where(F.col("size") >= least).join(concept, "concept", "left_semi")


def binary_matrix(classes: DataFrame, least: int = 2) -> DataFrame:
    """leaf, bits: a 0/1 string over the informative classes by (concept, cogid); a class that a leaf lacks is 0. The matrix itself has a cell for each leaf and class."""
    chars = informative(classes, least).select("concept", "cogid")
    leaves = classes.select("leaf").distinct()
    bit = leaves.crossJoin(chars).join(classes.select("leaf", "concept", "cogid").distinct().withColumn("bit", F.lit("1")), ["leaf", "concept", "cogid"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("concept", "cogid", F.coalesce("bit", F.lit("0")).alias("bit"))))
    return bit.groupBy("leaf").agg(F.array_join(F.transform(ordered, lambda x: x["bit"]), "").alias("bits"))


def fill(matrix: DataFrame) -> DataFrame:
    """The share of ones in each leaf's bits."""
    return matrix.select("leaf", (F.regexp_count("bits", F.lit("1")) / F.length("bits")).alias("share"))
