"""Substring dedup by recompression.

Every text, a string of word names, is recompressed in rounds: runs of one symbol, then pairs whose first symbol is
on the left and whose second is on the right side of a split of all symbols, get new names. Names are hashes of
what they stand for, so all of Spark's tasks give equal strings equal names without asking each other. Which symbols form inside a
window depends only on words near them; each symbol carries that extent. So every window can pick an anchor, the largest
symbol whose extent it holds, and equal windows pick equal anchors. Anchors that stand once end there; shared anchors
reveal repeats, which are verified: first by the whole stretch of words that an anchor stands for, and where stretches differ, window
by window.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sieve, sieved, small_batches, stored, texts, word_names

WINDOW = 50
ROUNDS = 4


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class Level:
    """Symbols of many texts in a row: names, first words, extents [low, high) that decide them, and their text's number."""

    def __init__(self, name, first, low, high, text):
        self.name, self.first, self.low, self.high, self.text = name, first, low, high, text


def merged_runs(x: Level, begin, end) -> Level:
    """Runs of a symbol become one symbol; each symbol now also depends on its neighbours."""
    import numpy as np

    same = (x.name[1:] == x.name[:-1]) & (x.text[1:] == x.text[:-1])
    start = np.flatnonzero(np.r_[True, ~same])
    stop = np.r_[start[1:], len(x.name)]
    long = stop - start > 1
    name = x.name[start]
    name[long] = mixed(name[long] + mixed((stop - start)[long].astype(np.uint64)))
    low, high = neighbours(x, start, stop, begin, end)
    return Level(name, x.first[start], low, high, x.text[start])


def neighbours(x: Level, start, stop, begin, end):
    """Extents of symbols [start, stop) with the symbol before and the one after; beyond the text at its ends."""
    import numpy as np

    text = x.text[start]
    before, after = np.maximum(start - 1, 0), np.minimum(stop, len(x.name) - 1)
    low = np.where((start > 0) & (x.text[before] == text), x.low[before], begin[text] - 1)
    high = np.where((stop < len(x.name)) & (x.text[after] == text), x.high[after], end[text] + 1)
    return low, high


def merged_pairs(x: Level, begin, end, number: int) -> Level:
    """Pairs of a left and a right symbol become one symbol; a symbol left alone depends on the neighbour that it might have joined."""
    import numpy as np

    right = (mixed(x.name + np.uint64((number + 1) * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(1)).astype(bool)
    pair = np.r_[~right[:-1] & right[1:] & (x.text[1:] == x.text[:-1]), False]
    second = np.r_[False, pair[:-1]]
    start = np.flatnonzero(~second)
    joined = pair[start]
    stop = start + 1 + joined
    wide_low, wide_high = neighbours(x, start, stop, begin, end)
    low = np.where(joined | ~right[start], x.low[start], wide_low)
    high = np.where(joined, x.high[stop - 1], np.where(right[start], x.high[start], wide_high))
    name = x.name[start]
    name[joined] = mixed(name[joined] * np.uint64(0x9E3779B97F4A7C15) + mixed(x.name[start[joined] + 1] + np.uint64(1)))
    return Level(name, x.first[start], low, high, x.text[start])


#: Stretches are hashed modulo this prime, 2^61 - 1.
PRIME = (1 << 61) - 1


def times(a, b):
    """a * b modulo PRIME, of 64-bit values below it."""
    import numpy as np

    bits, half = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> bits, a & half, b >> bits, b & half
    middle = ah * bl + al * bh
    total = np.uint64(2) * ah * bh + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << bits) + al * bl
    return below(below(total))


def below(x):
    """x modulo PRIME; at most PRIME once, below it if done twice or if x is small."""
    import numpy as np

    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


@functools.lru_cache(8)
def powers(bits: int, factor: int):
    """factor^i modulo PRIME for i below 2^bits."""
    import numpy as np

    out, step = np.ones(1, np.uint64), factor % PRIME
    for _ in range(bits):
        out = np.concatenate([out, times(out, np.uint64(step))])
        step = step * step % PRIME
    return out


class Hasher:
    """Polynomial hashes modulo a prime of any stretches of an array of 64-bit values: two different stretches of n values share one with a
    chance of n / 2^61, whatever they are."""

    FACTORS = (0x1E3779B97F4A7C15, 0x16E8FEB86659FD93)

    def __init__(self, values, which: int):
        import numpy as np

        n, factor = len(values), self.FACTORS[which]
        bits = n.bit_length()
        self.power = powers(bits, factor)
        each = times(below(mixed(values + np.uint64(which))), powers(bits, pow(factor, -1, PRIME))[:n])
        self.low = np.r_[np.uint64(0), np.cumsum(each & np.uint64(0xFFFFFFFF), dtype=np.uint64)]
        self.high = np.r_[np.uint64(0), np.cumsum(each >> np.uint64(32), dtype=np.uint64)]

    def of(self, start, stop):
        import numpy as np

        high = times(below(self.high[stop] - self.high[start]), np.uint64(1 << 32))
        return mixed(times(below(high + below(self.low[stop] - self.low[start])), self.power[start]))


def anchors(names, begin, end, window: int, rounds: int):
    """Text numbers, names, stretch hashes, and first and last window of each anchor, windows being counted from their text's start.

    names: the word names of all texts in a row; text i is [begin[i], end[i]).
    """
    import numpy as np

    if not len(names):  # only null, empty and blank texts
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(len(names), dtype=np.int64)
    x = Level(names, at, at, at + 1, text)
    for r in range(rounds):
        if r % 2 == 0:
            x = merged_runs(x, begin, end)
        x = merged_pairs(x, begin, end, r)
    n = len(names)
    p = at[at + window <= end[text]]  # starts of windows
    if not len(p):
        return [np.zeros(0, np.int64)] * 5
    # a window holds the symbols from the first with low >= p to the last with high <= p + window
    lo = np.cumsum(np.bincount(x.low + 1, minlength=n + 1))[p]
    hi = np.cumsum(np.bincount(x.high, minlength=n + 2))[p + window]
    length = np.diff(np.r_[x.first, n])
    rank = (np.uint64(63) - np.minimum(length, 63).astype(np.uint64) << np.uint64(58)) | (x.name >> np.uint64(6))
    best = [np.arange(len(rank))]
    while 2 ** len(best) <= window:
        half = 2 ** (len(best) - 1)
        a, b = best[-1], np.r_[best[-1][half:], best[-1][-half:]][: len(rank)]
        best.append(np.where(rank[a] <= rank[b], a, b))
    count = hi - lo
    chosen = np.full(len(p), -1, np.int64)
    for j, table in enumerate(best):
        mine = np.flatnonzero((count >= 2**j) & (count < 2 ** (j + 1)))
        a, b = table[lo[mine]], table[hi[mine] - 2**j]
        chosen[mine] = np.where(rank[a] <= rank[b], a, b)
    alone = chosen < 0  # such a window, as in a long run, is its own anchor
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | alone[1:] | (text[p[1:]] != text[p[:-1]])])
    last = np.r_[first[1:], len(p)] - 1
    start, stop, own = p[first], p[last] + window, alone[first]
    whole = Hasher(names, 0).of(start, stop)
    symbol = np.maximum(chosen[first], 0)
    offset = np.where(own, 0, x.first[symbol] - start)
    name = np.where(own, whole, x.name[symbol])
    stretch = mixed(whole + mixed(((stop - start) << 20).astype(np.uint64) + offset.astype(np.uint64)))
    t = text[start]
    return t, name, stretch, start - begin[t], p[last] - begin[t]


def repeated_words(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): the rows of docs with __maybe, false for those that certainly have no repeats, and doc_id and spans (arrays of [start, end) word places, any order, may overlap) of the windows that also start in a document
    with a smaller doc_id. Documents without such windows, and null doc_ids, have no row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def anchored(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, begin, end = word_names(texts(batch))
            t, name, stretch, low, high = anchors(names, begin, end, window, rounds)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[t].astype(np.int64)), pa.array(name.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["doc_id", "name", "stretch", "low", "high"])

    every = stored(docs.where("doc_id is not null").mapInArrow(anchored, "doc_id bigint, name bigint, stretch bigint, low int, high int"))
    kinds = every.groupBy("name", "stretch").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1").select("name", F.lit(True).alias("several"))
    shared = kinds.join(several, "name", "left").where("least < most or several").select("name", "stretch", "least", "several")
    known = stored(every.join(shared, ["name", "stretch"]).select("doc_id", "low", "high", (F.col("doc_id") > F.col("least")).alias("repeats"), F.coalesce("several", F.lit(False)).alias("several")).where("repeats or several"))
    # the first document of a stretch may share single windows with other stretches of the same anchor
    docs = sieved(docs, "doc_id", sieve(known.select("doc_id")))  # the texts of other documents aren't shuffled
    look = known.where("not repeats").groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            held, ranges = texts(batch), batch.column("ranges").to_pylist()
            for i in range(0, len(held), 200):  # few texts at a time: each makes a row for each window
                names, begin, _ = word_names(held[i : i + 200])
                at = [np.arange(b + r["low"], b + r["high"] + 1) for b, rs in zip(begin.tolist(), ranges[i : i + 200], strict=True) for r in rs]
                of = [np.full(sum(r["high"] + 1 - r["low"] for r in rs), d) for d, rs in zip(ids[i : i + 200].tolist(), ranges[i : i + 200], strict=True)]
                own = np.repeat(begin, [len(x) for x in of])
                at, of = np.concatenate(at), np.concatenate(of)
                h = [Hasher(names, k).of(at, at + window) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array((at - own).astype(np.int32)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))], ["doc_id", "pos", "h1", "h2"])

    single = docs.where("__maybe").drop("__maybe").join(look, "doc_id").select("doc_id", "text", "ranges").mapInArrow(windows, "doc_id bigint, pos int, h1 bigint, h2 bigint")
    least = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    found = single.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))
    spans = known.where("repeats").select("doc_id", F.col("low").alias("start"), (F.col("high") + window).alias("end")).unionByName(found)
    return docs, spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null and empty texts have no words. Rows that repeat a doc_id (and its text) don't count against each
    other; null doc_ids keep everything and count against nobody. Other columns are not read.
    """
    import numpy as np

    ids, gone = repeated_words(docs, window, rounds)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            n, removed, kept = [], [], []
            for t, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                ws = words(t)
                n.append(len(ws))
                if not spans:
                    removed.append(0)
                    kept.append(b" ".join(ws))
                    continue
                cover = np.zeros(len(ws) + 1, np.int64)
                np.add.at(cover, [s["start"] for s in spans], 1)
                np.add.at(cover, [s["end"] for s in spans], -1)
                stay = np.cumsum(cover)[:-1] == 0
                removed.append(int(len(ws) - stay.sum()))
                kept.append(b" ".join(w for w, s in zip(ws, stay.tolist(), strict=True) if s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    hit = ids.where("__maybe").drop("__maybe").join(gone, "doc_id", "left").select("doc_id", "text", "spans")
    rest = ids.where("not __maybe").select("doc_id", "text", F.lit(None).cast(gone.schema["spans"].dataType).alias("spans"))
    return hit.unionByName(rest).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
