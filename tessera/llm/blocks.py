"""Blocks of documents that ask shards of a model.

Texts lie in blocks, a model's counts in shards by key. A block sends each shard one message with its distinct keys, and gets the answers
back in the same order. Blocks are written once, in buckets, so that answers meet them without moving them.
"""

from __future__ import annotations

import pickle
import uuid

from pyspark.sql import DataFrame

from .common import shared_folder, small_batches, texts

#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
ASK = "block bigint, shard bigint, level bigint, kind bigint, data binary"


def pack(*arrays) -> bytes:
    """Arrays as compressed byte planes; whole numbers are kept as small as they fit."""
    import numpy as np
    import zstandard

    parts = []
    for x in arrays:
        if x.dtype.kind == "i" and len(x):
            x = x.astype(np.min_scalar_type(int(x.max())) if x.min() >= 0 else np.int64)
        parts.append((x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()))
    return zstandard.compress(pickle.dumps(parts), 6)


def unpack(data: bytes) -> list:
    """Only what pack() made in the same job; whole numbers come back as int64."""
    import numpy as np
    import zstandard

    out = []
    for kind, planes in pickle.loads(zstandard.decompress(data)):
        size = np.dtype(kind).itemsize
        x = np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()
        out.append(x.astype(np.int64) if x.dtype.kind in "iu" and kind != "<u8" else x)
    return out


def sorted_names(x):
    """Sorted 64-bit names as differences, which are smaller; np.cumsum() restores them."""
    import numpy as np

    return np.diff(x, prepend=np.uint64(0))


def pieces(shard):
    """(shard, slice) of each shard in a sorted array of shards."""
    import numpy as np

    edge = np.flatnonzero(np.r_[True, np.diff(shard) != 0, True]) if len(shard) else [0]
    return [(int(shard[a]), slice(int(a), int(b))) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def packed_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, weight=None) -> DataFrame:
    """(block, weight, data): the rows of docs (text and other columns) in blocks; weight(other columns, texts) is a number.

    Written to the shared folder in buckets by block.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]

    def pack_texts(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0

        def block():
            *others, held = zip(*rows, strict=True)
            columns = dict(zip(names, map(list, others), strict=True))
            data = zstandard.compress(pickle.dumps((columns, list(held))), 9)
            n = weight(columns, held) if weight else len(rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["block", "weight", "data"])

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), texts(batch), strict=True):
                rows.append(row)
                size += len(row[-1] or b"")
                if size >= block_bytes:
                    yield block()
                    rows, size, k = [], 0, k + 1
        if rows:
            yield block()

    spark = docs.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    writer = docs.mapInArrow(pack_texts, "block bigint, weight bigint, data binary").write.format("parquet")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def unpacked_block(data: bytes) -> tuple[dict[str, list], list]:
    """(columns, texts) of a block."""
    import zstandard

    return pickle.loads(zstandard.decompress(data))


def table_of(rows: list, names: str = ASK):
    """An Arrow table of rows, by the schema's names and types."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for c, (n, k) in zip(columns, fields, strict=True)})


def by_block(blocks: DataFrame, told: DataFrame | None, work, schema: str = ASK) -> DataFrame:
    """The rows that work(block, data, answers to it) gives for every block; told: the answers."""

    def alone(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield from table_of(work(block, data, []), schema).to_batches()

    def both(left, right):
        rows = right.select(["shard", "level", "data"]).to_pylist()
        return table_of([x for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True) for x in work(block, data, rows)], schema)

    return blocks.mapInArrow(alone, schema) if told is None else blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(both, schema)
