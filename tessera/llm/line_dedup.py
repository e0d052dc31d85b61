"""Line dedup by distinct-site spread.

Lines are grouped by a 128-bit hash. A HyperLogLog sketch of each line's sites, merged by Spark's
aggregation, estimates on how many sites it stands; lines within the sketch's error of the threshold get an exact
count. Lines at or above it are boilerplate: only their first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sieve, sieved, small_batches, split_join, stored, text_names, texts

MIN_SITES = 10
#: A line of a row; the order in which the first occurrence is found.
PLACE = ("doc_id", "pos", "t1", "t2")
SKETCH_BITS = 12


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text) and pos (0-based) of the lines to remove.

    A line is what stands between line feeds, without spaces, tabs and carriage returns at its ends; blank lines never
    count. A null site counts as a site of its own. The first occurrence by (doc_id, pos, hash of the text), null doc_id first, stays.
    """
    line = F.expr(r"trim(BOTH ' \t\r' FROM line)")
    lines = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_names("text"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", line)
        .where(F.col("line") != "")
        .select("doc_id", "t1", "t2", "site", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))
    )
    key = ["h1", "h2"]
    often = lines.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    # only lines that may stand often enough are written; each step below combines a line's rows before they are dealt out
    lines = stored(sieved(lines, "h1", sieve(often.select("h1"))).where("__maybe").drop("__maybe"))
    spread = stored(lines.groupBy(*key).agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", bits)).alias("sites"), F.min(F.struct(*PLACE)).alias("first")).where(F.col("n") >= min_sites))
    band = 4 * 1.04 / 2 ** (bits / 2)
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).drop("sites")
    near = spread.where(F.col("sites").between(min_sites * (1 - band), min_sites * (1 + band))).drop("sites")
    close = sieved(lines, "h1", sieve(near.select("h1"))).where("__maybe").select(*key, "site").distinct()
    exact = close.groupBy(*key).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select(*key)
    found = stored(sure.unionByName(near.join(exact, key)))
    rows = found.agg(F.sum("n")).first()[0] or 0
    hit = sieved(lines, "h1", sieve(found.select("h1"))).where("__maybe").select(*key, *PLACE)
    return split_join(hit, found, key, rows).where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE)


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, bits: int = SKETCH_BITS) -> DataFrame:
    """docs with boilerplate lines cut from text, plus n_lines and n_removed (columns __n_lines, __n_removed).

    Every row stays, with all its columns. Null text stays null with 0 lines; an empty text has 0 lines that count.
    Rows are told apart by doc_id and text: rows that repeat both share one decision per line. Columns named __n_lines or __n_removed are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("__n_lines", "__n_removed")
    gone = boilerplate(docs, site, min_sites, bits).groupBy(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).agg(F.collect_set("pos").alias("__gone"))
    gone = stored(gone)
    t1, t2 = text_names("text")
    # the texts of documents that lose no line aren't shuffled
    named = sieved(docs.withColumn("__a", t1).withColumn("__b", t2), "__a", sieve(gone.select("__t1")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__t1")) & (F.col("__b") == F.col("__t2"))
    hit = named.where("__maybe").join(gone, same, "left").select(*docs.columns, "__gone")
    rest = named.where("not __maybe").select(*docs.columns, F.lit(None).cast("array<int>").alias("__gone"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_removed", T.LongType())])
    names = docs.columns

    def cut(batches):
        import pyarrow as pa

        at = names.index("text")
        for batch in batches:
            kept, n, removed = [], [], []
            for t, gone in zip(texts(batch), batch.column(len(names)).to_pylist(), strict=True):
                lines = t.split(b"\n") if t is not None else []
                n.append(sum(bool(x.strip(b" \t\r")) for x in lines))
                removed.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    t = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                kept.append(t)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*names, "__n_lines", "__n_removed"])

    return hit.unionByName(rest).mapInArrow(cut, schema)
