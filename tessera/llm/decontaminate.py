"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark items are the patterns. A shift table over blocks of two words says how
far the search may move on; where it says 0, a bucket of the block's hash names the patterns that can end
there, and the words are compared one by one. Many places of a batch of texts move in step, so that the search
runs in numpy.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_names, texts

#: A-Z to a-z; every other ASCII character that is neither a digit nor a small letter to a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: Words of benchmark text whose tables are held at once; larger benchmarks are searched in blocks of this size.
BLOCK_WORDS = 1_000_000
TABLE_BITS = 18
LANES = 4096
#: Blocks of items that one pass over the documents searches at most.
CHAIN = 4


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


class Patterns:
    """Wu-Manber tables for all windows of one length."""

    def __init__(self, rows, owners):
        """rows: word numbers of the distinct windows; owners: for each, the item ids that hold it."""
        import numpy as np

        self.rows, self.owners = rows, owners
        n, self.m = rows.shape
        self.block = min(2, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.key(rows, j), self.m - 1 - j)
        suffix = self.key(rows, self.m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.first = np.searchsorted(suffix[self.order], np.arange((1 << TABLE_BITS) + 1))

    def key(self, rows, j):
        """Hashes of the blocks of each row that end at word j."""
        return self.hashed(rows[:, j - 1] if self.block == 2 else None, rows[:, j])

    def hashed(self, a, b):
        import numpy as np

        x = b.astype(np.int64) * 0x9E3779B1
        if a is not None:
            x += a.astype(np.int64) * 0x85EBCA6B
        return (x ^ (x >> 15)) & ((1 << TABLE_BITS) - 1)

    def occurrences(self, ids):
        """Starts and pattern numbers of all windows in an array of word numbers."""
        import numpy as np

        n = len(ids)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = max(1, min(LANES, (n - self.m + 1) // 32))
        edges = np.linspace(self.m - 1, n, lanes + 1).astype(np.int64)
        at, end, ends, keys = edges[:-1], edges[1:], [], []
        while at.size:
            key = self.hashed(ids[at - 1] if self.block == 2 else None, ids[at])
            step = self.shift[key]
            if (found := step == 0).any():
                ends.append(at[found])
                keys.append(key[found])
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        count = self.first[keys + 1] - self.first[keys]
        starts = np.repeat(ends - self.m + 1, count)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[np.repeat(self.first[keys], count) + place]
        for j in range(self.m):  # those that differ drop out word by word
            same = ids[starts + j] == self.rows[which, j]
            starts, which = starts[same], which[same]
        return starts, which


def nulls_last(item: int | None) -> tuple:
    return item is None, item or 0


def compiled(items: list[tuple[int | None, list[bytes]]], window: int) -> tuple[dict, list[Patterns]]:
    """The vocabulary and the tables for items, a list of (item id, words)."""
    import numpy as np

    number: dict[bytes, int] = {}
    grams: dict[int, dict[tuple, set]] = {}
    for item, ws in items:
        ids = [number.setdefault(w, len(number) + 1) for w in ws]
        m = min(window, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            grams.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
    return number, [Patterns(np.array(list(g), np.int64).reshape(len(g), m), [sorted(x, key=nulls_last) for x in g.values()]) for m, g in sorted(grams.items())]


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items of the benchmark in lists of about block_words words; the driver holds one list at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words((row.text or "").encode())
        if ws:
            held.append((row.item_id, ws))
            size += len(ws)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def found_in(held: list, number: dict, patterns: list):
    """For texts in bytes: their numbers of words, and by text the hit words as spans and the items found."""
    import numpy as np

    get = number.get
    flat, offsets = [], [0]
    for t in held:
        flat += [get(w, 0) for w in words(t)]
        flat.append(-1)
        offsets.append(len(flat))
    ids, offsets = np.array(flat, np.int64), np.array(offsets)
    cover = np.zeros(len(ids) + 1, np.int64)
    found: dict[int, set] = {}
    for p in patterns:
        starts, which = p.occurrences(ids)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + p.m, -1)
        for d, w in set(zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), which.tolist(), strict=True)):
            found.setdefault(d, set()).update(p.owners[w])
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2)
    spans: dict[int, list] = {}
    for d, (a, b) in zip((np.searchsorted(offsets, edge[:, 0], "right") - 1).tolist(), edge.tolist(), strict=True):
        spans.setdefault(d, []).append({"start": a - int(offsets[d]), "end": b - int(offsets[d])})
    return np.diff(offsets) - 1, spans, found


def searched(docs: DataFrame, items: list, window: int, *carried: str) -> DataFrame:
    """The carried columns, n_words, the hit words as spans [start, end), item_ids; for one block of items."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(compiled(items, window))

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            n, spans, found = found_in(texts(batch), *tables.value)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(c)) for c in carried),
                pa.array(n, pa.int64()),
                pa.array([spans.get(d, []) for d in range(len(n))], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(found.get(d, ()), key=nulls_last) for d in range(len(n))], pa.list_(pa.int64())),
            ], [*carried, "n_words", "spans", "item_ids"])

    return docs.select(*carried, "text").mapInArrow(search, "".join(f"{c} bigint, " for c in carried) + "n_words bigint, spans array<struct<start: bigint, end: bigint>>, item_ids array<bigint>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans [start, end) of hit words, item_ids that occur.

    A window is `window` consecutive words of an item, or all words of a shorter item. Null and empty texts have
    no words and no hits; items without words are ignored; items without id count as one item, null, last in item_ids; repeated items and
    repeated rows all report. Other columns of either table are not read. The benchmark is searched block by block, of block_words words each,
    so that tables are bounded; where there are several blocks, their findings are merged by doc_id and text, and rows that repeat both
    come out as often as they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = blocks(benchmark, block_words)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return searched(docs, first, window, "doc_id")
    key = ["doc_id", "t1", "t2"]
    docs = docs.select("doc_id", *text_names("text"), "text")
    every, n = searched(docs, first, window, *key), 1
    for items in itertools.chain([second], parts):
        every, n = every.unionByName(searched(docs, items, window, *key)), n + 1
    # what is found is a text's alone, so that equal rows have equal findings, as many times as there are blocks
    merged = every.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"), (F.count("*") / n).cast("int").alias("n"))
    last = "if(size(acc) > 0 and element_at(acc, -1).end >= x.start, {}, {})"
    joined = "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))"
    spans = F.expr(f"aggregate(array_sort(spans), cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) -> {last.format(joined, 'concat(acc, array(x))')})")
    return merged.select("doc_id", "n_words", spans.alias("spans"), F.array_sort("item_ids").alias("item_ids"), F.explode(F.sequence(F.lit(1), "n")).alias("n")).drop("n")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in whose text no benchmark window occurs, with all their columns; each row is judged by its own text.

    Each block of the benchmark passes on the rows that it finds clean, without a shuffle.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    for k, items in enumerate(blocks(benchmark, block_words)):
        docs = stored(docs) if k % CHAIN == CHAIN - 1 else docs
        tables = spark.sparkContext.broadcast(compiled(items, window))

        def clean(batches, tables=tables):
            import pyarrow as pa

            for batch in batches:
                n, spans, _ = found_in(texts(batch), *tables.value)
                yield batch.filter(pa.array([d not in spans for d in range(len(n))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
