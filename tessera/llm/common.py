"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is missing, only a master on this one machine gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, which survives lost executors."""
    context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the folder that the cluster shares for checkpoints.

    More compact than checkpoint(); it survives lost executors in the same way. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a sieve: a fixed size, which may be broadcast at any input size. A full sieve lets all through.
SIEVE_BITS = 24


def sieve(keys: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of the hashes of the one column of keys, as at most 2^(SIEVE_BITS - 6) rows."""
    at = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(1 << SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    return keys.groupBy(F.shiftright(at, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def sieved(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """df with the column __maybe: false if the key certainly isn't among those of the sieve."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    both = df.join(F.broadcast(words), F.shiftright(at, 6) == F.col("__word"), "left")
    return both.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


#: Keys with more than this share of all rows are split in split_join(); there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 2000, 100, 64


def split_join(many: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """many joined to one on keys, hot keys being dealt out to SALTS tasks.

    one has a row a key, and n, at least the number of rows that many has of the key; the n add up to about total. Columns n and __salt
    don't come through, and null keys join nothing.
    """
    hot = F.col("n") > max(HOT_ROWS, HOT_SHARE * total)
    named = [F.col(k).alias(f"__{k}") for k in keys]
    few = one.where(hot).select(*named, F.lit(True).alias("__hot"))  # fewer than 1 / HOT_SHARE rows at any input size
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = many.join(F.broadcast(few), same, "left").withColumn("__salt", salt).select(*many.columns, "__salt")
    copies = one.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def text_names(text: str) -> tuple[Column, Column]:
    """128 bits of hashes that, with doc_id, tell rows of a table apart where doc_ids are null or repeated."""
    return F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key is taken as the text 'null'."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % n


def texts(batch, name: str = "text") -> list:
    """The column's UTF-8 bytes; None where it is null."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Bytes that end words, as bytes.split() has it.
BLANKS = b" \t\n\r\x0b\x0c"
#: Words of more bytes than this are named one by one.
LONG_WORD = 4096


def word_names(batch: list):
    """(names, begin, end): 64-bit hashes of the words of all texts in a row, text i's being [begin[i], end[i]).

    A word's bytes are taken 8 at a time, each by a bijection of the hash so far, so that words of one length up to 8 bytes never share a
    name, and others share one by chance alone.
    """
    import numpy as np
    import xxhash

    joined = b" ".join(t or b"" for t in batch) + b" " * 9
    data = np.frombuffer(joined, np.uint8)[:-8]
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    edge = np.diff(np.r_[True, blank[data]].view(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = np.array([len(t or b"") + 1 for t in batch], np.int64)
    bounds = np.searchsorted(start, np.r_[0, np.cumsum(size)])
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # the 8 bytes from each place on
    length = stop - start
    names = mixed(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    at, rest, of = start, length, slice(None)
    while len(at):
        last = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.uint64(8) - np.minimum(rest, 8).astype(np.uint64) * np.uint64(8))
        names[of] = mixed((names[of] ^ (eight[at] & last)) + np.uint64(0xD6E8FEB86659FD93))
        more = np.flatnonzero((rest > 8) & (rest < LONG_WORD))
        of = more if isinstance(of, slice) else of[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length >= LONG_WORD):
        names[i] = xxhash.xxh3_64_intdigest(joined[start[i] : stop[i]])
    return names, bounds[:-1], bounds[1:]


def mixed(x):
    """A bijective scrambling of 64-bit values (splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
