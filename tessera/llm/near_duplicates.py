"""N-gram Jaccard join by a MinHash LSH forest.

Each text's word shingles give one MinHash signature (one hash per shingle, its minimum in each bin). Each tree of the forest is a trie over
its own bins: texts sorted by their bins, a node being a prefix that several texts share. The join starts at the longest prefix and verifies
the texts of each node exactly. From the similarities found so far follows how many links a prefix of any length finds, so the
prefix is shortened, and the nodes that have new pairs verified, until the target recall is reached.

Texts with equal shingle sets are one text from the start; nodes with equal members are looked at once; large nodes are split into blocks, and
each pair of blocks is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mixed, sieve, sieved, small_batches, split_join, stored, text_names, texts, word_names

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
#: Bins of each tree: the longest prefix.
DEPTH = 8
#: Bytes kept of each bin; bits for the number of a tree.
BIN, TREE_BITS = 2, 6
RECALL = 0.9995
#: Texts and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Classes of similarity, from the threshold to 1, by which links are counted.
BANDS = 20


def found_share(similarity: float, length: int, trees: int = TREES) -> float:
    """The probability that two texts of a similarity share a prefix of a length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def recall_at(bands: list[int], length: int, now: int, threshold: float, trees: int = TREES) -> float:
    """The share of all links that a prefix of `length` bins finds, estimated from links per band of similarity found with `now` bins.

    A band counts by its lower end, and one link at the threshold is taken to exist, so that too little evidence asks for a shorter prefix.
    """
    total = reached = 0.0
    for i, n in enumerate([*bands, 1]):
        s = threshold + (1 - threshold) * (i / len(bands) if i < len(bands) else 0.0)
        every = n / found_share(s, now, trees) if i < len(bands) else 1.0
        total += every
        reached += every * found_share(s, length, trees)
    return reached / total


def shorter(bands: list[int], now: int, threshold: float, recall: float, trees: int = TREES) -> int:
    """The longest prefix of up to `now` bins that reaches the target recall; 1 if none does."""
    return next((k for k in range(now, 1, -1) if recall_at(bands, k, now, threshold, trees) >= recall), 1)


def shingles(batch: list, size: int) -> list:
    """For each text the sorted distinct hashes of its shingles: `size` lower-case words, or all words of a shorter text."""
    import numpy as np

    names, begin, end = word_names([t.lower() if t else b"" for t in batch])
    out = []
    factor = np.uint64(0x9E3779B97F4A7C15)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        own = names[a:b]
        k = min(size, len(own))
        if not k:
            out.append(own)
            continue
        x = np.zeros(len(own) - k + 1, np.uint64)
        for j in range(k):
            x = x * factor + own[j : len(own) - k + 1 + j]
        out.append(np.unique(mixed(x + np.uint64(k))))
    return out


def signature(hashed, bins: int):
    """The least hash of each bin, by its high bits; an empty bin takes the next one's, changed by the distance."""
    import numpy as np

    x = mixed(hashed + np.uint64(0x5851F42D4C957F2D))
    bucket = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    at = np.lexsort((x, bucket))
    first = at[np.flatnonzero(np.r_[True, np.diff(bucket[at]) > 0])]
    full, least = bucket[first], x[first]
    place = np.searchsorted(full, np.arange(bins))
    away = np.where(place < len(full), full[place % len(full)], full[0] + bins) - np.arange(bins)
    return least[place % len(full)] + away.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def packed_signature(hashed, trees: int, depth: int) -> bytes:
    """The signature with BIN bytes a bin, tree by tree, so that a prefix of a tree is a prefix of its bytes."""
    return mixed(signature(hashed, trees * depth)).astype("<u2").tobytes()


def verified(ids, copies, side, signatures, sets, tree: int, length: int, before: int, depth: int, threshold: float):
    """Links of one task: for each row with any, (id, copies linked to it, the least id that it hangs together with here, links by band).

    side: 0 or 1 if rows of two blocks are to be compared, all 0 within one block. A pair counts in the first tree in which it shares
    `length` bins, and not at all if it shares `before` bins in some tree, as an earlier round had it.
    """
    import numpy as np

    n, trees = len(ids), len(signatures[0]) // (BIN * depth)
    bins = np.frombuffer(b"".join(signatures), "<u2").reshape(n, trees, depth)
    size = np.array([len(s) for s in sets])

    def same(t: int, k: int):
        _, number = np.unique(bins[:, t, :k], axis=0, return_inverse=True)
        number = number.ravel()
        return number[:, None] == number[None, :]

    link = same(tree, length)
    link &= size[:, None] >= threshold * size[None, :] - 1e-9
    link &= link.T
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side[None, :]
    for t in range(trees):
        if not link.any():
            return []
        if t < tree:
            link &= ~same(t, length)
        elif before <= depth:
            link &= ~same(t, before)
    if not link.any():
        return []
    rows = np.flatnonzero(link.any(axis=1))
    link, ids, copies, size = link[np.ix_(rows, rows)], ids[rows], copies[rows], size[rows]
    n, sets = len(rows), [sets[i] for i in rows]
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [a, a + width])
        m = np.zeros((n, width), np.float32)
        m[row[low:high], column[low:high] - a] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    link &= both >= threshold * union - 1e-6
    if not link.any():
        return []
    band = np.clip((both / union - threshold) / (1 - threshold) * BANDS if threshold < 1 else 0 * both, 0, BANDS - 1).astype(np.int8)
    links = link @ copies
    label = ids.copy()
    while True:  # the least id of each row's component
        new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    return [(int(i), int(k), int(x), np.bincount(b[m], minlength=BANDS).tolist()) for i, k, x, b, m in zip(ids, links, label, band, link, strict=True) if k]


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it hangs together with) of all nodes of edges (a, b), by alternating large and small stars."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        above = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        large = split_join(above, least, ["u"], edges.count()).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new = checkpointed(small)
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


LINK = "node bigint, links bigint, root bigint, bands array<int>"


def linked(nodes: DataFrame, docs: DataFrame, length: int, before: int, size: int, trees: int, depth: int, threshold: float, block: int) -> DataFrame:
    """One round: the links of all pairs whose longest shared prefix has at least `length` and fewer than `before` bins.

    nodes: node, copies, size, signature and the row (rep, t1, t2) of docs that has the text.
    """
    import numpy as np

    # a node of a tree by a hash of the tree and the prefix, with the tree's number in its low bits
    at = lambda k: F.expr(f"shiftleft(shiftright(xxhash64(tree, substring(signature, tree * {BIN * depth} + 1, {BIN * k})), {TREE_BITS}), {TREE_BITS}) | tree")
    member = nodes.select("node", "size", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", "size", at(length).alias("key"), at(min(before, depth)).alias("next"))
    often = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    member = sieved(member, "key", sieve(often)).where("__maybe").drop("__maybe")  # texts that are alone at a node aren't shuffled again
    buckets = member.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("s"), F.min("next").alias("least"), F.max("next").alias("most"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("x2")).where("m > 1")
    if before <= depth:
        buckets = buckets.where("least <> most")  # a node with one child has no new pairs
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("s") / BLOCK_SHINGLES)).cast("int")
    tree = F.col("key").bitwiseAND((1 << TREE_BITS) - 1).cast("int")
    once = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct(tree.alias("tree"), "key")).alias("b"), F.max(blocks).alias("blocks")).select("b.key", "blocks")
    dealt = member.join(once, "key").withColumn("tree", tree).withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    # each block meets every block of its node, itself included
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tree", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node")
    dealt = stored(dealt)
    wanted = nodes.join(dealt.select("node").distinct(), "node").select("node", "copies", "signature", F.col("rep").alias("__rep"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    wanted = stored(wanted)
    # few texts are shuffled
    likely = sieved(docs, "t1", sieve(wanted.select("__t1"))).where("__maybe").drop("__maybe")
    own = wanted.join(likely, F.col("doc_id").eqNullSafe(F.col("__rep")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))).dropDuplicates(["node"]).select("node", "copies", "signature", "text")

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            found = shingles(texts(batch), size)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "copies", "signature", "shingles"])

    task = ["tree", "key", "i", "j"]
    full = dealt.join(own.mapInArrow(sets, "node bigint, copies bigint, signature binary, shingles binary"), "node")
    # tasks are read as a stream from sorted partitions: one task's rows are held at a time
    full = full.select(*task, "mine", "node", "copies", "signature", "shingles").repartition(*task).sortWithinPartitions(*task)

    def verify(batches):
        import pyarrow as pa

        def out(found):
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int32()))], ["node", "links", "root", "bands"])

        held, found, current = [], [], None

        def done():
            if len(held) > 1:
                mine, node, copies, signatures, packed = zip(*held, strict=True)
                side = np.array([m != current[2] for m in mine])
                found.extend(verified(np.array(node), np.array(copies), side, signatures, [np.frombuffer(x, np.uint64) for x in packed], current[0], length, before, depth, threshold))

        for batch in batches:
            for tree, key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, key, i, j) != current:
                    done()
                    held, current = [], (tree, key, i, j)
                held.append(row)
            if found:
                yield out(found)
                found.clear()
        done()
        yield out(found)

    return stored(full.mapInArrow(verify, LINK))


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, t1, t2 (hashes of the text) and h1, h2 (of its shingles) of every row of docs, and for each h1, h2 that stands
    more than once or has links: copies, rep (the least doc_id), class (the number of its class), class_id (the class's least doc_id) and links."""
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *text_names("text"))

    def signed(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = []
            for s in shingles(texts(batch), size):
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), len(s), packed_signature(s, trees, depth)))
                else:
                    rows.append((None, None, 0, None))
            h1, h2, n, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "t1", "t2", "h1", "h2", "size", "signature"])

    every = stored(docs.mapInArrow(signed, "doc_id bigint, t1 bigint, t2 bigint, h1 bigint, h2 bigint, size bigint, signature binary"))
    first = F.min_by(F.struct("doc_id", "t1", "t2"), F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "t1", "t2"))
    nodes = every.where("h1 is not null").groupBy("h1", "h2").agg(first.alias("r"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("signature").alias("signature"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("r.doc_id").alias("rep"), "r.t1", "r.t2", "copies", "size", "signature"))
    length, before, rounds, bands = depth, depth + 1, [], [0] * BANDS
    while True:
        rounds.append(linked(nodes, docs, length, before, size, trees, depth, threshold, block))
        for r in rounds[-1].select(F.posexplode("bands").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # BANDS rows
            bands[r["i"]] += r["n"] // 2  # each link stands at both of its ends
        least = shorter(bands, length, threshold, recall, trees)
        if least >= length:
            break
        length, before = least, length
    links = rounds[0]
    for x in rounds[1:]:
        links = links.unionByName(x)
    label = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "h1", "h2", "rep", "copies").join(count, "node", "left").join(label, "node", "left").where("copies > 1 or links is not null")
    joined = stored(joined.withColumn("class", F.coalesce("label", "node")))
    out = joined.join(joined.groupBy("class").agg(F.min("rep").alias("least")), "class").select("class", F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "rep", "copies", F.col("least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return every.drop("size", "signature"), out


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, class_id, copy_id, n_links.

    Two rows are linked if their shingle sets' Jaccard similarity is at least threshold. copy_id is the least doc_id with the same
    shingle set, class_id the least doc_id of all that hang together by links, n_links the number of other rows linked to this one.
    Shingles are `size` words (split at white space, ASCII lower case); a shorter text is one shingle. Null texts and texts without
    words are linked to nothing: class_id and copy_id are the doc_id. Rows are told apart by doc_id and text: rows that repeat a doc_id with another
    text are rows of their own, repeated rows are copies, and null doc_ids are linked like others (class_id is null only if all ids of a class are).
    Other columns are not read.
    """
    rows, nodes = classes(docs, **options)
    same = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    out = rows.join(nodes, same, "left")
    alone = F.col("class").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that stand first in their class: by doc_id (nulls last), then by a hash of the text.

    Of rows with the same doc_id and text one stays. Null texts and texts without words stay as they are.
    """
    rows, nodes = classes(docs, **options)
    member = rows.join(nodes.select("class", "__h1", "__h2"), (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).select("class", "doc_id", "t1", "t2")
    first = member.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2")).alias("f"))
    # rows that stand more than once in a class go, but for the first
    key = member.groupBy("class", "doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    key = key.join(first, "class").withColumn("first", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t1") == F.col("f.t1")) & (F.col("t2") == F.col("f.t2"))).where("not first or n > 1")
    key = key.select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("first").alias("__first"))
    a, b = text_names("text")
    named = docs.withColumn("__a", a).withColumn("__b", b)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__t1")) & (F.col("__b") == F.col("__t2"))
    both = named.join(key, same, "left")
    kept = both.where("__first is null").select(*docs.columns)
    repeated = both.where("__first").dropDuplicates(["__id", "__a", "__b"]).select(*docs.columns)
    return kept.unionByName(repeated)
