"""The training-data operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, curriculum, decontaminate, language_id, line_dedup, media, near_duplicates, quality, substring_dedup, suffix_tree, symbols, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, keys string, copies string"
WORDS = [a + b for a in ("th", "er", "on", "in", "es") for b in ("a", "at", "en", "or", "is", "ou")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Passages, copies and near copies, odd texts, a very long text, nulls; columns that clash with the operators' own."""
    rng = random.Random(5)
    passage, base = sentence(rng, 70), sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n ", "one", "the end", base, base, " ".join(near), sentence(rng, 80) + " " + passage, passage + "\n" + sentence(rng, 90), sentence(rng, 30) + "\n" + passage + "\n" + base]
    texts += ["go " * 130, "go " * 55, "a b " * 60, "b a " * 40, "x" * 5000, sentence(rng, 4000) + " " + passage, "12 34 !!", "É à ü ñ " * 20, base.upper()]
    texts += [sentence(rng, rng.randint(3, 120)) for _ in range(20)]
    return [(i, t, None if i % 7 == 3 else "en" if i % 2 else "fr", None if i % 9 == 4 else f"s{i % 3}", 1, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_names():
    """Equal words, and only they, have equal names, of any length; words end where bytes.split() ends them."""
    flip = [b"a"]
    for _ in range(9):  # Thue-Morse: polynomials of any odd base can't tell it from its complement
        flip = [*flip, *(b"b" if x == b"a" else b"a" for x in flip)]
    word = b"".join(flip)
    got = common.word_names([word, word.translate(bytes.maketrans(b"ab", b"ba"))])[0]
    assert len(word) == 512 and got[0] != got[1]
    rng = random.Random(1)
    batches = [[None if rng.random() < 0.1 else bytes(rng.choice(b" \t\n\x0b\x0c\r\x1c\x00\xc2\x85\xa0ab") for _ in range(rng.choice([0, 1, 3, 30, 300]))) for _ in range(k % 5)] for k in range(100)]
    names = {}
    for batch in [*batches, [b"a" * 300_000 + b" b " + b"c" * 140_000, b"x" * 131_072 + b" y"]]:
        got, begin, end = common.word_names(batch)
        assert [int(n) for n in end - begin] == [len((t or b"").split()) for t in batch]
        for w, h in zip([w for t in batch for w in (t or b"").split()], got.tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def brute_substring(rows, n=50):
    first = {}
    for i, t in rows:
        ws = split(t)
        for p in range(len(ws) - n + 1):
            first[tuple(ws[p : p + n])] = min(i, first.get(tuple(ws[p : p + n]), i))
    out = {}
    for i, t in rows:
        ws = split(t)
        gone = {k for p in range(len(ws) - n + 1) if first[tuple(ws[p : p + n])] < i for k in range(p, p + n)}
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def test_substring(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substring([(r[0], r[1]) for r in corpus()])
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_random(spark):
    rng = random.Random(1)
    for trial in range(3):  # few words, so that runs, periods and chance repeats are common
        pool = [" ".join(rng.choice("abc"[: 2 + trial % 2]) for _ in range(rng.randint(1, 90))) for _ in range(12)]
        rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))) for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(df).collect()}
        assert got == brute_substring(rows)


def test_substring_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(None, t), (5, t), (5, t)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (True, 0)]


def test_substring_look_alikes(spark):
    """Words and stretches that polynomial hashes modulo 2^64 can't tell apart."""
    flip = "a"
    for _ in range(11):
        flip += flip.translate(str.maketrans("ab", "ba"))
    back = flip.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(49))
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, f"{head} {flip[:512]}"), (2, f"{head} {back[:512]}"), (3, f"{long} {' '.join(flip)}"), (4, f"{long} {' '.join(back)}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_substring(rows) and got[2][1] == 0


def test_substring_no_words(spark):
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, None), (2, ""), (3, " \t\n ")], "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted(got) == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, "")]


def brute_links(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").lower().split() if t is None or t.isascii() else (t or "").encode().lower().decode().split()
        k = min(5, len(ws))
        sets[i] = {tuple(ws[p : p + k]) for p in range(len(ws) - k + 1)} if k else set()
    links = {i: {j for j, b in sets.items() if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9} for i, a in sets.items()}
    out = {}
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        out[i] = (min(group), min([i, *(j for j in links[i] if sets[j] == sets[i])]), len(links[i]))
    return out


def test_jaccard(docs, empty, spark):
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in near_duplicates.jaccard_join(docs).collect()}
    assert got == brute_links([(r[0], r[1]) for r in corpus()])
    assert near_duplicates.jaccard_join(empty).count() == 0
    rng = random.Random(3)
    base = sentence(rng, 150).split()
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i in range(90) for k in (rng.randrange(150),)]  # a large group, in blocks
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in near_duplicates.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), block=16).collect()}
    assert got == brute_links(rows)
    kept = near_duplicates.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (c, _, _) in brute_links([(r[0], r[1]) for r in corpus()]).items() if c == i}


def test_jaccard_repeats(spark):
    """Rows that repeat a doc_id with another text are rows of their own; null ids are linked and kept once; repeated rows are copies."""
    rng = random.Random(8)
    w, v, u = (sentence(rng, 60) for _ in range(3))
    df = spark.createDataFrame([(1, w, "p"), (1, v, "q"), (2, w + " more", "r"), (3, v + " more", "s"), (None, u, "t"), (None, u + " more", "t"), (7, u, "u"), (8, None, "a"), (8, None, "b"), (9, "", "c"), (1, w, "z")], "doc_id bigint, text string, h1 string")
    got = sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in near_duplicates.jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 3, 1), (None, 7, 7, 2), (None, 7, None, 2), (7, 7, 7, 2), (8, 8, 8, 0), (8, 8, 8, 0), (9, 9, 9, 0)], key=str)
    kept = near_duplicates.representatives(df).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, w), (1, v), (7, u), (8, None), (8, None), (9, "")], key=str)


def test_forest_depth():
    """The prefix is as long as the links found allow, and reaches the target recall."""
    bands = lambda i, n: [n if k == i else 0 for k in range(near_duplicates.BANDS)]
    assert near_duplicates.shorter(bands(19, 10**6), 8, 0.8, 0.9995) == 8
    low = near_duplicates.shorter(bands(0, 1000), 8, 0.8, 0.9995)
    assert low == 4 and near_duplicates.found_share(0.8, low) >= 0.9995 > near_duplicates.found_share(0.8, low + 1)
    assert near_duplicates.shorter([0] * near_duplicates.BANDS, 8, 0.8, 0.9995) == 4  # no evidence
    assert 4 < near_duplicates.shorter(bands(4, 1000), 8, 0.8, 0.9995) < 8


def test_jaccard_recall(spark):
    """Recall against brute force on texts with edits of all sizes; no false link."""
    rng = random.Random(12)
    rows = []
    for _ in range(60):
        base = sentence(rng, rng.randint(20, 200)).split()
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(WORDS) + "x"
            rows.append((len(rows), " ".join(t)))
    want = brute_links(rows)
    got = {r.doc_id: r.n_links for r in near_duplicates.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    every = sum(n for _, _, n in want.values())
    assert all(got[i] <= want[i][2] for i in want) and sum(got.values()) >= 0.995 * every > 100


def test_components(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 30)] + [(29, 40), (41, 40)] + [(i, i + 1) for i in range(100, 120)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (1, 0)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: m for x, m in label.items() if m != x and x in linked}


def test_decontamination(docs, empty, spark):
    rows = corpus()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    items = [(1, " ".join(rows[5][1].split()[20:45]).upper()), (2, None), (3, "!!"), (4, "the end"), (9, "GO, go; go"), (11, rows[16][1][5000:5400]), (10, rows[16][1][5000:5400]), (12, "É à")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t, *_ in rows:
        ws, hit, found = low(t), set(), set()
        for item, b in items:
            bs = low(b)
            m = min(10, len(bs))
            grams = {tuple(bs[p : p + m]) for p in range(len(bs) - m + 1)} if m else set()
            for p in range(len(ws) - m + 1):
                if m and tuple(ws[p : p + m]) in grams:
                    hit |= set(range(p, p + m))
                    found.add(item)
        want[i] = (len(ws), len(hit), sorted(found))
    for size in (1_000_000, 20):  # one block of items, and many
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in decontaminate.contamination(docs, bench, block_words=size).collect()}
        assert got == want
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    clean = decontaminate.decontaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, (_, _, f) in want.items() if not f} and clean.columns == docs.columns


def test_decontamination_null_items(spark):
    """Items without id hit words and count as one item, as in the SQL."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "b c"), (None, "c d"), (7, "a b"), (None, "y")], "item_id bigint, text string")
    for size in (1_000_000, 2):
        got = {r.doc_id: (sum(s.end - s.start for s in r.spans), r.item_ids) for r in decontaminate.contamination(docs, bench, block_words=size).collect()}
        assert got == {1: (4, [7, None]), 2: (1, [None]), 3: (0, [])}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [3]


def test_decontamination_rows(spark):
    """Rows are judged by their own text, whatever ids repeat or are null, and however the benchmark is split."""
    rows = [(5, "a b c d"), (5, "q r s"), (5, "a b c d"), (None, "a b"), (None, "clean one"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_ids string")
    bench = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "r s"), (4, "zz yy")], "item_id bigint, text string")
    want = sorted([(5, 4, 4, [1, 2]), (5, 3, 2, [3]), (5, 4, 4, [1, 2]), (None, 2, 2, [1]), (None, 2, 0, []), (None, 2, 2, [1]), (None, 0, 0, [])], key=str)
    for size in (1_000_000, 2):
        got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in decontaminate.contamination(df, bench, block_words=size).collect()]
        assert sorted(got, key=str) == want
        clean = decontaminate.decontaminated(df, bench, block_words=size)
        assert clean.columns == df.columns and sorted(clean.collect(), key=str) == [(None, "clean one", "x"), (None, None, "x")]


def test_lines_repeats(spark):
    """A row with another text under the same id keeps its lines; repeated rows share one decision."""
    rows = [(i, f"often\nown {i}", f"s{i}") for i in range(12)] + [(5, "unique first line\nother", "s5"), (6, "own\noften", "s6"), (6, "own\noften", "s6"), (None, "often\nx", "s1")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()), key=str)
    assert got == sorted([(i, f"own {i}") for i in range(12)] + [(5, "unique first line\nother"), (6, "own"), (6, "own"), (None, "often\nx")], key=str)


def test_lines(docs, empty, spark):
    rows = [(i, f" head \nbody {i}\n\n{'often' if i < 12 else 'rare'}\nhead", f"s{i % 11}" if i % 11 else None) for i in range(24)] + [(50, None, "s1"), (51, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("__n_lines", F.lit("mine"))
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_removed"]) for r in line_dedup.line_dedup(df, min_sites=11).collect()}
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r"):
                sites[x.strip(" \t\r")].add(s)
                first.setdefault(x.strip(" \t\r"), (i, p))
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for p, x in enumerate(lines) if not (k := x.strip(" \t\r")) or len(sites[k]) < 11 or first[k] == (i, p)]
        assert got[i] == (None if t is None else "\n".join(keep), sum(bool(x.strip()) for x in lines), len(lines) - len(keep))
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(docs).count() == docs.count()


def test_split_join(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    many = spark.createDataFrame([(k, i) for k in (1, 2, None) for i in range(20 if k == 1 else 3)], "k bigint, i int")
    one = spark.createDataFrame([(1, 20, "a"), (2, 3, "b"), (5, 9, "c")], "k bigint, n bigint, x string")
    for total in (26, 100_000):  # key 1 is hot, and no key is
        got = common.split_join(many, one, ["k"], total)
        assert got.columns == ["k", "i", "x"]
        assert sorted(map(tuple, got.collect())) == sorted([(1, i, "a") for i in range(20)] + [(2, i, "b") for i in range(3)])


def test_lines_hot(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i % 30, f"hot\nown {i}", f"s{i % 10}") for i in range(60)] + [(None, "hot", None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 61 and all(r["__n_removed"] == int(r.doc_id is not None) for r in got)  # the first occurrence has a null doc_id


def test_mixture(docs, empty):
    rows = [(r[0], len(split(r[1])), r[3]) for r in corpus()]
    total = defaultdict(int)
    for _, n, s in rows:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:  # share, stop at twice the size, reshare
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in full or free:
            goal[s] = 2.0 * total[s] if full else level * weight[s]
        free -= full or free
        left = 1.5 * sum(total.values()) - sum(goal.values())
    got = curriculum.mixture(docs, slice_rows=2).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, n, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == total[r.source] and r.taken <= 2 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(r.size for r in got if r.source == s) / 2 + 1e-6
    assert sorted(map(tuple, (r[:9] for r in curriculum.mixture(docs.repartition(5)).collect())), key=str) == sorted((tuple(r[:9]) for r in got), key=str)
    assert curriculum.mixture(empty).count() == 0
    mixed = curriculum.mixed_documents(docs).collect()
    assert len(mixed) == sum(r.copies for r in got) and [r.position for r in mixed] == sorted(r.position for r in mixed)


def test_mixture_rows(spark):
    """Null and repeated ids with other texts are rows of their own, with places of their own; ties and repeated rows have defined places."""
    rows = [(None, f"w{i} x{i}", "s") for i in range(6)] + [(7, "a b", "s"), (7, "c d", "s"), (8, "e f", "s"), (8, "e f", "s"), (9, None, None), (9, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, position int")
    got = [curriculum.mixed_documents(df.repartition(k)).collect() for k in (1, 4)]
    assert sorted(map(tuple, got[0]), key=str) == sorted(map(tuple, got[1]), key=str) and df.columns[:3] == got[0][0].__fields__[:3]
    assert {(r.doc_id, r.text) for r in got[0]} == {r[:2] for r in rows if r[1]}
    places = {(r.text, r.copy): r.position for r in got[0]}
    assert len(set(places.values())) == len(places)


def test_media(docs, empty, spark):
    extra = spark.createDataFrame([(100 + i, r[1], None, None, 1, "x", "y", "z") for i, r in enumerate(corpus())] + [(None, "no id", None, None, 1, "x", "y", "z")], SCHEMA)
    got = media.media_columns(docs.unionByName(extra)).collect()
    assert len(got) == 2 * docs.count() + 1
    text = {r[0]: r[1] for r in corpus()} | {100 + i: r[1] for i, r in enumerate(corpus())} | {None: "no id"}
    for r in got:
        b = (text[r.doc_id] or "").encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    assert sum(r.n_shared for r in got) > 0
    assert media.media_columns(empty).count() == 0
    m = media.wav(random.Random(1).randbytes(50_000))
    parts = media.chunks(m, media.gear())
    assert b"".join(parts) == m and len(parts) > 5 and all(media.LEAST <= len(p) <= media.MOST for p in parts[:-1])
    shifted = set(media.chunks(b"abc" + m, media.gear()))
    assert len(shifted & set(parts)) >= len(parts) - 2  # cuts follow the content


def test_media_passages(spark):
    """A passage of 50 words in two otherwise different texts is stored once, in part."""
    rng = random.Random(11)
    passages = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(50)) for _ in range(20)]
    other = lambda: " ".join(f"v{rng.randrange(10**9)}" for _ in range(100))
    rows = [(i, other() + " " + passages[i % 20] + " " + other()) for i in range(40)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 40 and sum(r.n_shared > 0 for r in got) >= 20
    assert all(r.media_sha256 == hashlib.sha256(media.wav(media.payload_of(t.encode()))).hexdigest() for i, t in rows for r in got if r.doc_id == i)


def tree_tokens(t):
    return [*split("".join(c.lower() if c.isascii() else c for c in t or "")), "\n"]


def brute_tree(rows, depth, least, gain):
    """Scores by a search for each token's longest kept context, over plain dictionaries."""
    out = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    c, after = Counter(), defaultdict(Counter)
    before = lambda ws, p, d: tuple(ws[p - k] if k <= p else None for k in range(d, 0, -1))
    for i, t in rows:
        if not out(i):
            ws = tree_tokens(t)
            c.update(ws)
            for p, w in enumerate(ws):
                for d in range(1, depth + 1):
                    after[before(ws, p, d)][w] += 1
    total, kinds = sum(c.values()), len(c)
    kept = {}

    def probability(w, context):
        if not context:
            return (c[w] + 1) / (total + kinds + 1)
        p, own = probability(w, context[1:]), after.get(context, Counter())
        m = sum(own.values())
        if context not in kept:
            base = {x: probability(x, context[1:]) for x in own}
            kept[context] = m >= least and sum(n * math.log((n - 1 + len(own) * base[x]) / (m - 1 + len(own)) / base[x]) for x, n in own.items()) >= gain
        return (own[w] + len(own) * p) / (m + len(own)) if kept[context] else p

    got = {}
    for i, t in rows:
        ws = tree_tokens(t)
        got[i] = (out(i), len(ws), sum(w in c for w in ws), total, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ws), sum(math.log10(probability(w, before(ws, p, depth))) for p, w in enumerate(ws)))
    return got, kept


def test_suffix_tree(docs, empty):
    """Against brute force: without split contexts, and with many; in one block a partition, and in many."""
    for depth, shards, size in ((3, 1, 1 << 20), (4, 40, 3000), (2, 300, 1)):
        want, kept = brute_tree([(r[0], r[1]) for r in corpus()], depth, 2, 2.0)
        assert 0 < sum(kept.values()) < len(kept)
        got = suffix_tree.suffix_tree_scores(docs, depth=depth, shards=shards, block_bytes=size).collect()
        assert len(got) == len(want)
        for r in got:
            h, n, known, total, base, score = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-4)
    assert suffix_tree.suffix_tree_scores(empty).count() == 0


def test_suffix_tree_rows(spark):
    """Null and repeated ids, nothing to learn from, columns that clash, and ties."""
    df = spark.createDataFrame([(None, "a b a b", 1.0), (None, None, 1.0), (3, "a b", 2.0), (3, "a b", 2.0)], "doc_id bigint, text string, score double")
    got = suffix_tree.suffix_tree_scores(df).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 3), (False, 3), (True, 1), (True, 5)]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    none = suffix_tree.suffix_tree_scores(spark.createDataFrame([(held[0], "a b")], "doc_id bigint, text string")).first()
    assert (none.held_out, none.n_tokens, none.n_known, none.train_tokens, none.score, none.base_score) == (True, 3, 0, 0, 0.0, 0.0)


def test_suffix_tree_grows(spark):
    """Contexts that stand twice are kept however large the rest is; a text that stands twice scores above its like that stands once."""
    rng = random.Random(6)
    fresh = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    twice = fresh()
    rows = [(i, twice if k < 2 else fresh()) for k, i in enumerate(learn)]
    got = {r.doc_id: r.score for r in suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert min(got[learn[0]], got[learn[1]]) > max(got[i] for i in learn[2:]) + 10


def brute_kneser_ney(rows, order):
    """P(symbol | context) by the textbook's recursion over plain dictionaries of symbol strings."""
    levels = [Counter()]
    for ids in rows:
        padded = (0,) * (order - 1) + tuple(ids) + (0,)
        levels[0].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]  # of 1 to order symbols; all but the last count the different symbols before
    cuts = [quality.discounts(Counter(c.values())) for c in levels]

    def p(gram):
        if not gram:
            return 1 / symbols.SYMBOLS
        c, d = levels[len(gram) - 1], cuts[len(gram) - 1]
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        n = c.get(gram, 0)
        return max(n - d[min(n, 3)], 0) / total + sum(d[min(x, 3)] for x in same.values()) / total * p(gram[1:])

    return p


def test_kneser_ney(spark):
    """Perplexities, with characters that share a symbol, against brute force, in one block and in many; distributions add up to 1."""
    import numpy as np

    rng = random.Random(13)
    learn = [(i, sentence(rng, 6) + rng.choice(["é!", "", "漢字 x", "zz"])) for i in range(12)]
    score = [*learn[:4], (50, None), (51, ""), (52, "never seen Q 漢"), (53, "thor the")]
    schema = "doc_id bigint, text string"
    df, ids = spark.createDataFrame(learn, schema), spark.createDataFrame([(i,) for i, _ in learn], "doc_id bigint")
    fitted = quality.fit(df, ids, order=3)
    (symbol, own), _, model = fitted
    p = brute_kneser_ney([[int(symbol[ord(c)]) for c in t] for _, t in learn], 3)
    for shards, size in ((1, 1 << 20), (7, 1)):
        got = {r.doc_id: r for r in quality.perplexities(spark.createDataFrame(score, schema), fitted, shards=shards, block_bytes=size).collect()}
        for i, t in score:
            s = (0, 0, *(int(symbol[ord(c)]) for c in t or ""), 0)
            bits = sum(math.log2(p(s[k : k + 3])) for k in range(len(s) - 2)) + sum(float(own[ord(c)]) for c in t or "")
            assert got[i].n_symbols == len(t or "") + 1 and got[i].perplexity == pytest.approx(2 ** (-bits / (len(t or "") + 1)), rel=1e-4)
    code = np.arange(64**2)
    assert np.allclose(model.shorter.reshape(-1, 64).sum(axis=1), 1) and model.shorter[code[70]] == pytest.approx(p((1, 6)))


def test_quality(spark, docs, empty):
    """Thresholds by language from their own fold; clashing columns, null languages and ids, empty texts, no labels."""
    rng = random.Random(14)
    rows = [(i, sentence(rng, 40), "en" if i % 2 else "fr", 9.9) for i in range(120)] + [(500, "#$%&* 0147 ~~ <<>> ^^^ 77 @@" * 4, "en", 9.9), (501, None, "en", 9.9), (502, "", None, 9.9), (None, sentence(rng, 40), None, 9.9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(5, 1, 0), (500, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    assert len(got) == len(rows) and not any(got[i].keep for i in (500, 501, 502)) and got[None].keep
    assert sum(got[i].keep for i in range(120)) >= 118
    by_fold = lambda k: [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == k]
    assert all(got[i].held_out == (i in by_fold(0)) for i in range(100))
    for lang in ("en", "fr"):
        own = sorted(got[i].perplexity for i in by_fold(1) if got[i].lang == lang)
        assert got[by_fold(1)[0]].threshold > 0 and any(got[i].threshold == pytest.approx(own[-1] * 1.15) for i in range(120) if got[i].lang == lang)
    assert quality.quality(empty, labels).count() == 0 and quality.quality(docs, labels.limit(0)).where("keep").count() == docs.count() - 2


def test_quality_of_many(spark):
    """All trusted documents are learned from, however many, and no others; thresholds are exact quantiles, also of ties and for null."""
    df = spark.range(0, 60_000, 1, 4).selectExpr("cast(id as int) as doc_id", "if(id % 2 = 0, concat('a', id % 3), 'zz') as text")
    (symbol, _), counts, _ = quality.fit(df, spark.range(0, 60_000, 2).selectExpr("if(id = 0, null, id) as doc_id"), order=2)
    got, want = {r.code: r.n for r in counts.collect()}, Counter()
    for i in range(2, 60_000, 2):
        a, b = (int(symbol[ord(c)]) for c in f"a{i % 3}")
        want.update([a, a << 6 | b, b << 6])
    assert got == want
    rows = spark.range(0, 200_000, 1, 4).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, 'one', 'x')) as lang", "if(id % 4 = 1, 2.5, exp((id * 7919 % 200003) / 40000) * 0.5) as y")
    held = rows.toPandas()
    for q in (0.0001, 0.5, 0.99, 1.0):
        found = {r.lang: r.y for r in quality.quantiles(rows, "lang", "y", q).collect()}
        assert found == {k: sorted(held.y[held.lang.isna() if k is None else held.lang == k])[math.ceil(q * n) - 1] for k, n in ((None, 50_000), ("one", 50_000), ("x", 100_000))}


def segmentations(w):
    if not w:
        yield []
    for k in range(1, len(w) + 1):
        for rest in segmentations(w[k:]):
            yield [w[:k], *rest]


def test_segmentations():
    import numpy as np

    vocabulary = sorted({"▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"})
    lattice = language_id.Lattice(vocabulary)
    number = {p: i for i, p in enumerate(vocabulary)}
    table = np.r_[np.random.default_rng(0).dirichlet(np.ones(len(vocabulary)), 2).T, [[1e-7, 1e-7]]]
    for w in ("aba", "bazb", "abab" * 3):
        brute = np.zeros(2)
        for s in segmentations("▁" + w):
            if all(p in number or len(p) == 1 for p in s):
                brute += np.prod([table[number.get(p, len(vocabulary))] for p in s], axis=0)
        assert language_id.log_probabilities(lattice, table, [w])[0] == pytest.approx(np.log(brute))


def test_long_words():
    """Words of any length are scored in whole and learned from, and the vocabulary's longest pieces count."""
    import numpy as np

    vocabulary = sorted({"▁", "a", "b", "ab", "abababababababab", "z" * 16})
    lattice = language_id.Lattice(vocabulary)
    table = np.full((len(vocabulary) + 1, 1), 0.1)
    table[-1] = 1e-7
    for w in ("ab" * 500, "q" * 300, "z" * 33):
        logs = [0.0]  # plain dynamic programming in logs
        for i in range(1, len(w) + 2):
            ways = [logs[i - k] + math.log(0.1 if ("▁" + w)[i - k : i] in vocabulary else 1e-7) for k in range(1, min(i, 16) + 1) if ("▁" + w)[i - k : i] in vocabulary or k == 1]
            top = max(ways)
            logs.append(top + math.log(sum(math.exp(x - top) for x in ways)))
        assert language_id.log_probabilities(lattice, table, [w])[0, 0] == pytest.approx(logs[-1])
    p = language_id.fitted(vocabulary, ["z" * 64, "b" * 90], np.array([5.0, 1.0]))
    assert p[vocabulary.index("z" * 16)] > 0.1 and p[vocabulary.index("b")] > 0.3 and p[:-1].sum() == pytest.approx(1)
    assert max(map(len, language_id.pieces())) > 8


def test_expectation(spark):
    """One round of expectation-maximisation against all segmentations."""
    import numpy as np

    vocabulary = sorted({"▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"})
    words, n = ["aba", "abab", "b"], np.array([3.0, 1.0, 2.0])
    p, expected = 1 / len(vocabulary), Counter()
    for w, times in zip(words, n, strict=True):
        ways = [s for s in segmentations("▁" + w) if all(x in vocabulary for x in s)]
        every = sum(p ** len(s) for s in ways)
        for s in ways:
            for x in s:
                expected[x] += times * p ** len(s) / every
    want = np.array([expected[x] + 0.01 for x in vocabulary])
    assert language_id.fitted(vocabulary, words, n, 1)[:-1] == pytest.approx(want / want.sum())


def test_language(spark, docs, empty):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[x]) for _ in range(3)) for _ in range(20)), x) for i in range(80) for x in (("aa", "bb")[i % 2],)]
    rows += [(900, None, "aa"), (901, " 12 ²", "bb"), (902, "kalomi", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x in rows[:80])
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "aa")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.language_id(docs).count() == docs.count() and language_id.language_id(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        t, bad = sentence(rng, 40), i % 4 == 0
        rows.append((i, t + (" you zorgface ." if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(500, None), (501, ""), (502, "no zorgface here")]
    labels += [(0, 1, 1), (999, 1, 1), (None, 1, 1), (7, 1, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and got[500].score == got[501].score < 0.5
    assert got[502].score < got[0].score
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == docs.count()
    assert toxicity.toxicity(empty, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_grammar():
    s = toxicity.Scorer({"zorg*": 6.0})
    plain, aimed = s.matches("a zorgface thing.")[0], s.matches("you zorgface thing.")[0]
    assert s.matches("never a zorgface thing.")[0] < plain < aimed and s.matches("he said that a zorgface left.")[0] < plain + 0.5
    assert s.matches("fine words only.") == (0.0, 0) and s.matches("zorga. zorgb.")[1] == 2


def test_composition():
    """The composed machine marks what the three transducers mark one after the other."""
    rng = random.Random(9)
    parts, whole = toxicity.machines(), toxicity.grammar()
    for _ in range(300):
        states, state = [0, 0, 0], 0
        for _ in range(12):
            x = y = rng.randrange(6)
            marks = 0
            for k, machine in enumerate(parts):
                states[k], y, m = machine.step(states[k], y)
                marks |= m
            state, z, got = whole.step(state, x)
            assert (z, got) == (y, marks)


def test_scores_by_hand():
    """A document's score from its clauses' marks, weights and cap, and how labels move the weights."""
    import numpy as np

    s = toxicity.Scorer({"zorg*": 6.0, "blah": 3.0})
    text = "you zorgface! it is not a blah, she said: zorg kill them. fine"
    #        aimed insult; negated insult and a target met; the report ends at the colon; insult, threat and a target met
    w = toxicity.START
    want = (6 * w["insult"] + w["target"]) + (3 * w["insult"] * w["negated"] + w["target"]) + min(12.0, 6 * w["insult"] + w["threat"] + w["target"])
    clauses = s.clauses(text)
    assert len(clauses) == 3 and s.matches(text)[0] == pytest.approx(want)
    assert s.score(text)[0] == pytest.approx(1 / (1 + math.exp(-w["constant"] - want)))
    assert toxicity.features(clauses) == [12.0, 3.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 3.0]
    x = np.array([[4.0] + [0.0] * 8, [0.0, 4.0] + [0.0] * 7, [0.0] * 9])
    harmless = toxicity.fitted_weights(x, np.array([1, 0, 0]), np.array([500.0, 500.0, 5000.0]))
    as_bad = toxicity.fitted_weights(x, np.array([1, 1, 0]), np.array([500.0, 500.0, 5000.0]))
    assert harmless["negated"] < 0.2 < 0.6 < as_bad["negated"] and harmless["constant"] < -2


def test_clashing_columns(spark):
    """Columns that have the names of an operator's own don't reach its results, whatever they hold."""
    rows = [(i, sentence(random.Random(i), 20), "en", "s1") for i in range(30)]
    df = spark.createDataFrame([(*r, None, "x", -1.0, "z", True) for r in rows], "doc_id bigint, text string, lang string, source string, y int, lang_pred string, score double, term string, held_out boolean")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0), "q") for i in range(30)], "doc_id bigint, quality int, toxic int, text string")
    plain = df.select("doc_id", "text", "lang", "source")
    for run in (lambda d: toxicity.toxicity(d, labels), language_id.language_id, suffix_tree.suffix_tree_scores, near_duplicates.jaccard_join, substring_dedup.substring_dedup):
        assert sorted(map(tuple, run(df).collect())) == sorted(map(tuple, run(plain).collect()))


def test_long_texts(spark):
    """Texts of hundreds of thousands of words, judged to their last word."""
    words = " ".join(WORDS[i % 30] + WORDS[i * 7 % 30] for i in range(200_000))
    rows = [(1, words + " you zorgface."), (2, words), (3, "short\n" + "long line " * 50_000 + "\nboiler"), *((10 + i, f"boiler\nown {i}") for i in range(12))]
    df = spark.createDataFrame([(*r, f"s{r[0]}") for r in rows], "doc_id bigint, text string, source string")
    scorer = toxicity.Scorer({"zorg*": 9.0})
    got = {r.doc_id: (r.score, r.n_clauses) for r in toxicity.scored(df, ({"zorg*": 9.0}, toxicity.START)).collect()}
    assert got[1] == pytest.approx(scorer.score(rows[0][1])) and got[1][0] > 0.9 > 0.1 > got[2][0]
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert kept[3] == rows[2][1] and kept[10] == "own 0" and kept[1] == rows[0][1]
    classes = {r.doc_id: r.class_id for r in near_duplicates.jaccard_join(df).collect()}
    assert classes[2] == classes[1] == 1
    model = quality.fit(df, spark.createDataFrame([(2,)], "doc_id bigint"), order=2)
    sizes = {r.doc_id: r.n_symbols for r in quality.perplexities(df, model).collect()}
    assert all(sizes[i] == len(t) + 1 for i, t in rows)
