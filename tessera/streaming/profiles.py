"""n-gram profiles of a stream of units, kept up as units arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_sql, ngrams


def running_profile(units: DataFrame, n: int = 3) -> DataFrame:
    """leaf, gram, c of a stream (leaf, text); to be written in complete or update mode."""
    return units.select("leaf", F.explode(ngrams(clean_sql(F.col("text")), n)).alias("gram")).groupBy("leaf", "gram").agg(F.count("*").alias("c"))


def windowed_profile(units: DataFrame, n: int = 3, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """The same for each window of event time ts; units later than delay are left out."""
    t = units.withWatermark("ts", delay)
    return t.select("ts", "leaf", F.explode(ngrams(clean_sql(F.col("text")), n)).alias("gram")).groupBy(F.window("ts", window), "leaf", "gram").agg(F.count("*").alias("c"))
