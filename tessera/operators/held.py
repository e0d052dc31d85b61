"""Tables that are computed once, and sent to all executors only if they are small."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is sent to all executors, at most; larger ones are joined by key.
MOST_SENT = 200_000


def held(df: DataFrame) -> DataFrame:
    """df, kept by the executors once it is computed; what a lost executor held is computed again."""
    return df if df.is_cached else df.persist(StorageLevel.MEMORY_AND_DISK)


def sent(df: DataFrame) -> DataFrame:
    """df for the side of a join: held, counted, and broadcast if it has at most MOST_SENT rows."""
    df = held(df)
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df
