"""Media columns by content-defined payload chunking.

A text's bytes, padded to a multiple of 64, are the samples of an 8-bit mono WAV file. A rolling gear hash cuts the file into
chunks where its content says so, so that equal passages give equal chunks. Chunks of one file alone stay in its own row, compressed together;
chunks that different files may hold go to a shared store, one row a digest, and equal files have one body. Ordered chunk lists rebuild
every file, which is verified by its digest before its samples are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, texts

UNIT = 64
RATE = 8000
#: Chunk sizes in bytes: none smaller but the last, none larger; cuts come about every 2^CUT_BITS bytes beyond the least, so that
#: a shared passage of 50 words (some 350 bytes) holds whole chunks.
LEAST, MOST, CUT_BITS = 64, 8192, 7
#: Bits of the filters of files and of digests that stand more than once: a fixed size. If one fills up, more goes to the shared stores, no more.
FILTER_BITS = 26
#: Between the values of common letters.
MIDDLE = 107
GEAR_SEED = 0x6D656469
HEADER = 44


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes and bytes 0 up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes(max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def wav(samples: bytes) -> bytes:
    """An 8-bit mono PCM WAV file; sizes of 4 GB or more can't be stored."""
    import struct

    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def samples_of(media: bytes) -> bytes:
    import struct

    kind, form, rate, bits, n = media[:4], media[8:16], *struct.unpack("<I", media[24:28]), *struct.unpack("<H", media[34:36]), *struct.unpack("<I", media[40:44])
    if (kind, form, rate, bits, HEADER + n) != (b"RIFF", b"WAVEfmt ", RATE, 8, len(media)):
        raise ValueError("not a WAV file of this module")
    return media[HEADER:]


def gear():
    """256 fixed pseudo-random 32-bit values."""
    import numpy as np

    x = np.arange(256, dtype=np.uint64) + np.uint64(GEAR_SEED)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31)) >> np.uint64(16)).astype(np.uint32)


def cuts(media: bytes, table) -> list[int]:
    """Ends of the chunks. The gear hash at a byte is the sum of the last 32 bytes' values, each shifted by its distance."""
    import numpy as np

    h = table[np.frombuffer(media, np.uint8)]
    for j in range(5):  # windows of 2, 4, 8, 16, 32 bytes
        w = 1 << j
        shifted = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += shifted
    places = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, n = [], 0, len(media)
    for p in [*places, n]:
        while p - start > MOST:
            start += MOST
            out.append(start)
        if p - start >= LEAST or p == n and p > start:
            out.append(p)
            start = p
    return out


def chunks(media: bytes, table) -> list[bytes]:
    ends = cuts(media, table)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(chunk).digest()[:16]


def short(d: bytes) -> int:
    """64 bits of a digest, as a signed number."""
    return int.from_bytes(d[:8], "little", signed=True)


def packed(chunk: bytes) -> bytes:
    import zstandard

    return zstandard.compress(chunk, 3)


def features(samples: bytes) -> str:
    """Mean, mean square and crossings of MIDDLE by the samples, and the loudest of 8 bands of values."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    band = int(np.bincount(x >> 5, minlength=8).argmax())
    return f"mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) // len(x)};crossings={int(np.count_nonzero(np.diff(x >= MIDDLE)))};band={band}"


def bits_of(keys: DataFrame):
    """A filter of fixed size with a bit for each of the one column of numbers (and for what shares its bit)."""
    import numpy as np

    at = F.col(keys.columns[0]).bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2^(FILTER_BITS - 6) rows
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def has(bits, key: int) -> bool:
    place = key & ((1 << FILTER_BITS) - 1)
    return bool(bits[place >> 6] >> (place & 63) & 1)


def lent_chunks(docs: DataFrame) -> DataFrame:
    """Short digests of the chunks that stand in two files or more; docs: text, file (a hash of the text)."""

    def found(batches):
        import pyarrow as pa

        table = gear()
        for batch in batches:
            least: dict[int, int] = {}
            most: dict[int, int] = {}
            for t, f in dict(zip(texts(batch), batch.column("file").to_pylist(), strict=True)).items():
                for c in chunks(wav(payload_of(t)), table):
                    d = short(digest(c))
                    least[d], most[d] = min(f, least.get(d, f)), max(f, most.get(d, f))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (least, least.values(), most.values())], ["digest", "least", "most"])

    seen = docs.select("text", "file").mapInArrow(found, "digest bigint, least bigint, most bigint")
    return seen.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("digest")


BODY = "media_sha256 string, n_bytes bigint, n_chunks bigint, n_shared bigint, own binary, list array<struct<digest: binary, size: bigint>>"


def media_store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, bodies, shared): all written to the folder that the cluster shares.

    files has a row for each row of docs: doc_id, n_bytes, media_sha256, and, if no other row may have the same text, the file's body; bodies has
    the other bodies, one row a media_sha256. A body is n_chunks, n_shared, own, the compressed bytes of all chunks that aren't in shared, and
    list, the file in order: the digest of a chunk in shared, or null and the size of a stretch of own. shared has digest and own, one row
    a digest, by joining equal digests of chunks that different files hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("file"))
    copied = docs.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    both = spark.sparkContext.broadcast((bits_of(copied), bits_of(lent_chunks(docs))))

    def filters():
        return (memoryview(x).cast("Q") for x in both.value)

    def body(media: bytes, table, lent) -> tuple:
        parts, order, own, k = chunks(media, table), [], [], 0
        for c in parts:
            if has(lent, short(d := digest(c))):
                order.append({"digest": d, "size": None})
                k += 1
                continue
            own.append(c)
            if order and order[-1]["digest"] is None:
                order[-1]["size"] += len(c)
            else:
                order.append({"digest": None, "size": len(c)})
        return len(parts), k, packed(b"".join(own)), order

    def table_of(rows, first):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int64())]))]
        names = [*first, "n_chunks", "n_shared", "own", "list"]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*first.values(), *kinds], strict=True)], names)

    def files(batches):
        import hashlib

        import pyarrow as pa

        table, (copies, lent) = gear(), filters()
        for batch in batches:
            rows = []
            for i, f, t in zip(batch.column("doc_id").to_pylist(), batch.column("file").to_pylist(), texts(batch), strict=True):
                media = wav(payload_of(t))
                rows.append((i, len(t or b""), hashlib.sha256(media).hexdigest(), *((None,) * 4 if has(copies, f) else body(media, table, lent))))
            yield table_of(rows, {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media_sha256": pa.string()})

    def bodies(batches):
        import hashlib

        import pyarrow as pa

        table, (copies, lent) = gear(), filters()
        for batch in batches:
            rows = []
            for t, f in dict(zip(texts(batch), batch.column("file").to_pylist(), strict=True)).items():
                if has(copies, f):
                    media = wav(payload_of(t))
                    rows.append((hashlib.sha256(media).hexdigest(), len(t or b""), *body(media, table, lent)))
            yield table_of(rows, {"media_sha256": pa.string(), "n_bytes": pa.int64()})

    def shared(batches):
        import pyarrow as pa

        table, (_, lent) = gear(), filters()
        for batch in batches:
            own = {}
            for t in set(texts(batch)):
                for c in chunks(wav(payload_of(t)), table):
                    if has(lent, short(d := digest(c))) and d not in own:
                        own[d] = packed(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], ["digest", "own"])

    once = docs.select("text").mapInArrow(shared, "digest binary, own binary").groupBy("digest").agg(F.min("own").alias("own"))
    kept = docs.select("text", "file").mapInArrow(bodies, BODY).groupBy("media_sha256").agg(*[F.first(c).alias(c) for c in ("n_bytes", "n_chunks", "n_shared", "own", "list")])
    return stored(docs.mapInArrow(files, f"doc_id bigint, n_bytes bigint, media_sha256 string, {BODY.split(", ", 2)[2]}")), stored(kept), stored(once)


def read_back(files: DataFrame, bodies: DataFrame, shared: DataFrame) -> DataFrame:
    """Rebuilds each file from its chunk list, verifies it and reads its samples; a body that several files share is rebuilt once.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks, n_shared. A chunk or file that
    doesn't match its digest raises an error. Files without shared chunks are read where they lie, without a shuffle.
    """
    kind = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks bigint, n_shared bigint"

    def rebuilt(batches):
        import hashlib
        import zlib

        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [x.split()[0] for x in kind.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in kind.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lent = {x["pos"]: x["own"] for x in r.get("lent") or ()}
                own, at, parts = unpack(r["own"]), 0, []
                for i, x in enumerate(r["list"]):
                    if x["digest"] is not None:
                        parts.append(unpack(lent[i]))
                    else:
                        parts.append(own[at : at + x["size"]])
                        at += x["size"]
                media = b"".join(parts)
                if any(x["digest"] is not None and digest(c) != x["digest"] for c, x in zip(parts, r["list"], strict=True)) or hashlib.sha256(media).hexdigest() != r["media_sha256"]:
                    raise ValueError(f"the stored form of document {r['doc_id']} is damaged")
                samples = samples_of(media)
                rows.append((r["doc_id"], r["n_bytes"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), r["media_sha256"], features(samples), r["n_chunks"], r["n_shared"]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def whole(rows: DataFrame) -> DataFrame:
        """rows: doc_id and bodies, of which no two have one media_sha256."""
        some = rows.where("n_shared > 0").withColumn("sha", F.unhex(F.substring("media_sha256", 1, 32)))
        wanted = some.select("sha", F.posexplode("list").alias("pos", "x")).select("sha", "pos", "x.digest").where("digest is not null")
        lent = wanted.join(shared, "digest").groupBy("sha").agg(F.collect_list(F.struct("pos", "own")).alias("lent"))
        return rows.where("n_shared = 0").mapInArrow(rebuilt, kind).unionByName(some.join(lent, "sha").select(*rows.columns, "lent").mapInArrow(rebuilt, kind))

    once = whole(bodies.withColumn("doc_id", F.lit(None).cast("bigint"))).drop("doc_id")
    copies = files.where("list is null").select("doc_id", "media_sha256").join(once, "media_sha256")
    return whole(files.where("list is not null")).unionByName(copies)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, as read_back() describes; a null text is empty, null and repeated doc_ids are allowed."""
    return read_back(*media_store(docs))
