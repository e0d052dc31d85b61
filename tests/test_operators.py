"""Hand-computed values and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import characters, distances, inference, neighbors, profiles, quartets, trees
from tessera.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).head()[0]


def prof(spark, rows):
    return spark.createDataFrame(rows, "leaf string, gram string, c bigint")


def test_clean(spark):
    assert tx.cleaned("İSTANBUL İNSAN") == "istanbul insan"
    assert tx.cleaned("Éa, 12b!", keep_diacritics=False) == "ea b"
    assert one(spark, tx.clean()("t"), t="İSTANBUL İNSAN") == "istanbul insan"
    assert one(spark, tx.clean_sql(F.col("t")), t=" Straße 9-x ") == "strasse x"
    assert one(spark, tx.clean_sql(F.col("t")), t=None) is None


@pytest.mark.parametrize(("text", "n", "expected"), [("abcab", 3, ["abc", "bca", "cab"]), ("ab", 3, []), ("", 1, []), ("a b", 1, ["a", " ", "b"]), ("a𝒜b\n", 2, ["a𝒜", "𝒜b", "b\n"])])
def test_ngrams(spark, text, n, expected):
    assert one(spark, tx.ngrams(F.col("t"), n), t=text) == expected


def test_labels_and_tokens(spark):
    assert one(spark, tx.safe(F.col("t")), t="a (b) c!") == "a_b_c"
    assert one(spark, tx.safe(F.col("t")), t="--") == "X"
    assert one(spark, tx.asjp_tokens(F.col("t")), t='ab~c *d"ef$') == ["ab", "c", "def"]
    assert one(spark, tx.base_of(F.col("t")), t="__label__eng_Latn") == "eng"
    assert one(spark, tx.script_of(F.col("t")), t="__label__eng_Latn") == "Latn"
    assert bytes(one(spark, tx.byte_cap(F.col("t"), 2), t="éa")) == "é".encode()
    assert one(spark, tx.ndist(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(3 / 7)
    assert one(spark, tx.fixed_script(F.col("a"), F.col("b")), a="Icelandic", b="Ethiopic") == "Latin"
    assert sorted(one(spark, tx.shuffle_chars(1)("t"), t="abcabc")) == sorted("abcabc")
    assert one(spark, tx.transcribed(F.col("t"), F.lit("x"), {"x": {"a": "b"}}), t="aa").asDict() == {"text": "bb", "status": "ok"}
    tables = {"x": {"a": "b"}, "bad": lambda t: 1 / 0, "blank": lambda t: " "}
    for text, code, want in (("aa", "y", "not installed"), ("aa", None, "no map"), ("cc", "x", "unchanged"), ("aa", "blank", "unchanged"), ("aa", "bad", "error"), (None, "x", "unchanged")):
        got = one(spark, tx.transcribed(F.col("t"), F.lit(code).cast("string"), tables), t=text)
        assert (got.text, got.status) == (None, want)


def test_entropies(spark):
    p = prof(spark, [("x", "a", 2), ("x", "b", 2)])
    assert profiles.block_entropy(p).head().h == pytest.approx(1.0)
    assert profiles.block_entropy(p, "mm").head().h == pytest.approx(1 + 1 / (8 * math.log(2)))
    assert spark.range(1).select(profiles.digamma(F.lit(1.0))).head()[0] == pytest.approx(-0.5772156649, abs=1e-9)
    with pytest.raises(ValueError, match="estimator"):
        profiles.block_entropy(p, "other")
    sim = {(r.n, r.estimator): r.h for r in profiles.entropy_simulation(spark, sizes=(128,), reps=20).collect()}
    assert sim[128, "plugin"] < sim[128, "mm"] < sim[128, "grassberger"] == pytest.approx(6, abs=0.1)


def test_js(spark):
    p = prof(spark, [("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "z", 3), ("d", "x", 5)])
    d = {(r.i, r.j): r.d for r in distances.js(p).collect()}
    assert d["a", "b"] == pytest.approx(0.557923, abs=1e-6)
    assert d["a", "c"] == 1.0
    assert d["a", "d"] == pytest.approx(0.0, abs=1e-7)
    smooth = {(r.i, r.j): r.d for r in distances.js(p, 0.5).collect()}
    q, r = [1.5 / 2, 0.5 / 2], [1.5 / 3, 1.5 / 3]
    want = sum(0.5 * x * math.log2(2 * x / (x + y)) + 0.5 * y * math.log2(2 * y / (x + y)) for x, y in zip(q, r, strict=True))
    assert smooth["a", "b"] == pytest.approx(math.sqrt(want))


def test_other_distances(spark):
    p = prof(spark, [("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("b", "c", 1), ("b", " ", 1)])
    assert distances.jaccard(p).head().d == pytest.approx(2 / 3)
    c = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 1)], "leaf string, concept int, cogid int")
    assert distances.cognates(c).head().d == pytest.approx(1 / 3)
    t = spark.createDataFrame([("a", "abc " * 200), ("b", "abc " * 200), ("c", "xyq " * 200)], "leaf string, text string")
    d = {(r.i, r.j): r.d for r in distances.ncd(t).collect()}
    assert d["a", "b"] < d["a", "c"]
    u = spark.createDataFrame([("a", "ab ab ab"), ("b", "ab ab ab"), ("c", "zz zz")], "leaf string, text string")
    e = {(r.i, r.j): r.d for r in distances.perplexity(profiles.profile(u)).collect()}
    assert e["a", "b"] == pytest.approx(0.0) and e["a", "c"] > 0


def test_neighbors(spark):
    dist = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.1), ("b", "c", 0.5)], "i string, j string, d double")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "leaf string, group string")
    near = {r.i: (r.j, r.ties) for r in neighbors.nearest(dist).collect()}
    assert near == {"a": ("b", 2), "b": ("a", 1), "c": ("a", 1)}
    first, miss, drop = (neighbors.purity(dist, groups, t).head() for t in ("first", "miss", "drop"))
    assert (first.purity, miss.purity, drop.purity) == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 2))
    assert drop.n == 2
    g = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "leaf string, group string")
    assert neighbors.chance_floor(g).head().chance == pytest.approx(1 / 3)


def test_trees(spark):
    dist = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("a", "d", 6.0), ("b", "c", 6.0), ("b", "d", 6.0), ("c", "d", 4.0)], "i string, j string, d double")
    newick = trees.build(dist).head().newick
    assert newick == "((a,b),(c,d));"
    assert trees.splits_of(newick) == trees.splits_of("(a:1,b:2,(c:1,'d':1)x:3);") == {frozenset("ab")}
    assert trees.splits_of(trees.build(dist, "nj").head().newick) == {frozenset("ab")}
    assert trees.cophenetic_corr(dist).head().r > 0.9
    assert trees.rf_of(newick, newick) == 0 and trees.rf_of(newick, "((a,c),(b,d));") == 1
    assert trees.splits_of("(((a_1,b),c),(d,(e,f)));") == {frozenset({"a_1", "b"}), frozenset({"a_1", "b", "c"}), frozenset({"e", "f"})}
    assert trees.gold_newick([("a", "X"), ("b", "X"), ("c", "")]) == "(c,(a,b));"
    r = trees.rf_triple(spark, newick, "((a,b),c,d);", list("abcd"), 20).head()
    assert r.observed == 0 and r.n_splits == 1


def test_containing_clade(spark):
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("a", "z"), ("f", "z"), ("c", "w"), ("d", "w")], "leaf string, group string")
    clades = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c", "d", "e"],), (["b", "c", "d"],)], "split array<string>")
    got = {r.group: (r.clade, r.size, r.exact) for r in trees.containing_clade(groups, clades).collect()}
    assert got == {"x": (["a", "b"], 2, True), "y": (["a", "b", "c"], 3, False), "z": (None, None, None), "w": (["b", "c", "d"], 3, False)}


def test_quartets(spark):
    leaves = spark.createDataFrame([(x,) for x in "abcd"], "leaf string")
    q = quartets.quartets(leaves)
    add = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), *((x, y, 2.0) for x in "ab" for y in "cd")], "i string, j string, d double")
    assert quartets.delta(q, add).head().delta == 0
    gold = spark.createDataFrame([(["a", "b"],)], "split array<string>")
    assert quartets.gqd(q, gold, gold).head().gqd == 0
    assert quartets.gqd(q, spark.createDataFrame([(["a", "c"],)], "split array<string>"), gold).head().gqd == 1
    assert len(quartets.quartets(spark.range(80).select(F.col("id").cast("string").alias("leaf")), n_sample=50).collect()) == 50


def test_inference(spark):
    dist = spark.createDataFrame([(f"l{i}", f"l{j}", float((i * 7 + j * 3) % 11)) for i in range(6) for j in range(i + 1, 6)], "i string, j string, d double")
    r = inference.mantel(dist, dist, 19).head()
    assert r.r == pytest.approx(1.0) and r.p <= 0.2
    units = spark.createDataFrame([("a", 1, "abcabc"), ("a", 2, "abab"), ("b", 1, "abcab"), ("b", 2, "xyxy"), ("c", 1, "zzz"), ("c", 2, "zzzz")], "leaf string, unit_id bigint, text string")
    for kind in ("bigint", "string"):  # ids of any type
        reps = inference.block_replicates(units.withColumn("unit_id", F.col("unit_id").cast(kind)), 5)
        assert reps.count() == 15 and reps.where("d < 0 or d > 1").count() == 0
    weights = inference.unit_weights(units, 7)
    assert {r.rep: r.n for r in weights.groupBy("rep").agg(F.sum("w").alias("n")).collect()} == dict.fromkeys(range(7), 2)
    per_leaf = inference.leaf_replicates(units, "a", 7)
    assert per_leaf.select("rep").distinct().count() == 7
    perm = inference.permutations(units.select("leaf"), 6).collect()
    assert all(sorted(r.other for r in perm if r.rep == k) == list("abc") for k in range(7)) and all(r.leaf == r.other for r in perm if r.rep == 0)
    assert len({tuple(r.other for r in sorted(perm) if r.rep == k) for k in range(7)}) > 2


def test_token_draws(spark):
    """Names that are anagrams get draws of their own, and a draw has as many tokens as its leaf."""
    p = prof(spark, [(leaf, g, 50) for leaf in ("user_12", "user_21") for g in ("aaa", "bbb", "ccc")])
    got = inference.token_draw(p, 4).collect()
    assert all(sum(r.c for r in got if (r.rep, r.leaf) == (k, leaf)) == 150 for k in range(4) for leaf in ("user_12", "user_21"))
    assert inference.token_replicates(p, 4).where("d > 0").count() == 4


def test_rf_replicates(spark):
    far = lambda rep, pair: [(rep, x, y, 1.0 if {x, y} in pair else 9.0) for k, x in enumerate("abcd") for y in "abcd"[k + 1 :]]
    reps = spark.createDataFrame(far(0, [{"a", "b"}, {"c", "d"}]) + far(1, [{"a", "c"}, {"b", "d"}]), "rep bigint, i string, j string, d double")
    gold = spark.createDataFrame([(["a", "b"],)], "split array<string>")
    assert {r.rep: r.rf for r in inference.rf_replicates(reps, gold).collect()} == {0: 0.0, 1: 1.0}
    assert inference.rf_interval(reps, gold).head().med == 0.5
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "leaf string, group string")
    assert inference.purity_interval(reps, groups).head().med == 0.5


def joined_counts(rows, n, cap=None):
    from collections import Counter

    out = {}
    for leaf in sorted({r[0] for r in rows}):
        t = " ".join(t for x, _, t in sorted(rows) if x == leaf and t)[:cap].rstrip()
        out |= {(leaf, g): c for g, c in Counter(t[i : i + n] for i in range(len(t) - n + 1)).items()}
    return out


def test_joined_profile(spark):
    """Grams across units of all lengths, against the joined text; nothing is lost at caps."""
    import random

    rng = random.Random(3)
    rows = [(leaf, u, "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 1, 2, 3, 7]))).strip()) for leaf in "xyz" for u in range(12)] + [("w", 1, "a"), ("v", 1, "")]
    df = spark.createDataFrame(rows, "leaf string, unit_id int, text string")
    for n in (1, 2, 3, 4, 5):
        got = {(r.leaf, r.gram): r.c for r in profiles.joined_profile(df, n).collect()}
        assert got == joined_counts(rows, n)
    for cap in (1, 5, 11):
        got = {(r.leaf, r.gram): r.c for r in profiles.joined_profile(profiles.capped_units(df, cap), 2).collect()}
        assert got == joined_counts(rows, 2, cap)
        assert {r.leaf: r.text for r in profiles.joined_units(df, cap).collect()} == {x: t for x in "wxyz" for t in (" ".join(t for y, _, t in sorted(rows) if x == y and t)[:cap].rstrip(),)}
    h = {(r.leaf, r.n): r.h for r in profiles.ladder(df).collect()}
    one_by_one = {(r.leaf, n): r.h for n in range(1, 5) for r in profiles.block_entropy(profiles.profile(df, n)).collect()}
    assert h == pytest.approx(one_by_one)


def test_ncd_basic(spark):
    import gzip

    size = lambda t: len(gzip.compress(t.encode(), 9, mtime=0))
    t = {"a": "abc " * 50, "b": "abd " * 40}
    got = distances.ncd(spark.createDataFrame(list(t.items()), "leaf string, text string"), "basic").head().d
    assert got == pytest.approx((size(t["a"] + t["b"]) - min(map(size, t.values()))) / max(map(size, t.values())))


def test_tree_tools(spark):
    dist = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("a", "d", 6.0), ("b", "c", 6.0), ("b", "d", 6.0), ("c", "d", 4.0)], "i string, j string, d double")
    bars = {r.step: (r.x_left, r.x_right, r.y_left, r.y_right, r.y) for r in trees.layout(trees.linkage(dist)[0]).collect()}
    assert bars == {0: (5.0, 15.0, 0.0, 0.0, 2.0), 1: (25.0, 35.0, 0.0, 0.0, 4.0), 2: (10.0, 30.0, 2.0, 4.0, 6.0)}
    table = lambda *x: spark.createDataFrame([(list(t),) for t in x], "split array<string>")
    null = [r.rf for r in trees.label_shuffle_null(table("ab"), table("ab"), spark.createDataFrame([(x,) for x in "abcd"], "leaf string"), 40).collect()]
    assert len(null) == 40 and set(null) <= {0.0, 1.0} and 0 < sum(null) < 40  # of one split: the same, or both differ over 2 (4 - 3)
    r = trees.tree_comparison(spark, "((a,c),(b,(d,e)));", "((a,b),(c,(d,e)));", 20).head()
    assert (r.gqd, r.resolved_in_gold, r.approx) == (0.4, 5, False) and r.observed == 0.5
    lines = spark.createDataFrame([("x", 0, "l1"), ("x", 1, "g"), ("x", 2, "f"), ("y", 0, "l2"), ("y", 1, "g"), ("y", 2, "f"), ("z", 0, "l3"), ("z", 1, "f"), ("w", 0, "l4"), ("w", 1, "h"), ("v", 0, "v")], "leaf string, depth int, ancestor string")
    assert trees.lineage_newick(lines, {"x": "X!"}) == "(v,(z,(X!,y)),w);"
    assert sorted(tuple(r.split) for r in trees.lineage_splits(lines).collect()) == [("v", "w"), ("x", "y")]
    splits = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["c", "d"],)], "split array<string>")
    assert trees.internal_bipartitions(splits).head().n == 2


def test_word_rows(spark):
    w = spark.createDataFrame([("a", 1, ["h", "", "a"]), ("b", 1, [])], "leaf string, concept int, tokens array<string>")
    assert [tuple(r) for r in characters.word_rows(w).collect()] == [("a", "1", 0, "h", "h a"), ("a", "1", 1, "a", "h a")]


def test_sampler_model(spark):
    """Every reference has its element; every estimated parameter has a move, and the rates and the tree have priors."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(writers.sampler_xml(spark.createDataFrame([("x", "010"), ("y", "110")], "leaf string, bits string")))
    ids = [e.get("id") for e in root.iter() if e.get("id")]
    assert len(ids) == len(set(ids))
    refs = [v[1:] for e in root.iter() for v in e.attrib.values() if v.startswith("@")] + [e.get("idref") for e in root.iter() if e.get("idref")]
    assert set(refs) <= set(ids)
    estimated = {e.get("id") for e in root.iter() if e.get("name") == "stateNode"}
    moved = {v[1:] for e in root.iter("operator") for v in e.attrib.values() if v.startswith("@")} | {x.get("idref") for e in root.iter("operator") for x in e}
    assert estimated == moved == {"tree", "birthRate", "clockRate", "frequencies"}
    prior = next(e for e in root.iter("distribution") if e.get("id") == "prior")
    assert {e.get("x") for e in prior if e.get("x")} == {"@birthRate", "@clockRate"}
    clock = next(e for e in root.iter("branchRateModel"))
    assert clock.get("clock.rate") == "@clockRate" and [e.get("value") for e in root.iter("sequence")] == ["010", "110"]


def test_readers(spark, tmp_path):
    units = spark.createDataFrame([("f1", "v1", "a b"), ("f1", "v2", "c"), ("f1", "v3", "d"), ("f2", "v1", "x"), ("f2", "v3", "y z")], "file string, unit_id string, text string")
    meta = spark.createDataFrame([("f1", "A"), ("f2", "B")], "Filename string, leaf string")
    got = lambda **o: sorted(tuple(r) for r in readers.corpus(meta, units, **o).collect())
    assert got() == [("A", "v1", "a b"), ("A", "v3", "d"), ("B", "v1", "x"), ("B", "v3", "y z")]
    assert got(cap=1) == [("A", "v1", "a b"), ("B", "v1", "x")]
    assert got(cap=2, align=False)[1] == ("A", "v2", "c")
    assert got(char_cap=4, return_units=False) == [("A", "a b"), ("B", "x y")]
    assert got(char_cap=5) == [("A", "v1", "a b"), ("A", "v3", "d"), ("B", "v1", "x"), ("B", "v3", "y z")]
    u = spark.createDataFrame([("A", 1, " "), ("A", 2, "one"), ("A", 3, "two"), ("B", 1, "")], "leaf string, unit_id int, text string")
    t = spark.createDataFrame([("A", "unused text here."), ("B", "short. long enough part! another one here。x")], "leaf string, text string")
    assert sorted(tuple(r) for r in readers.usable_lines(u, t, 1).collect()) == [("A", "one"), ("B", "long enough part")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = readers.line_files(frame([("a", "L"), ("b", "L"), ("c", "L"), ("d", "L")], "iso string, script string"), frame([("a_L",), ("z_L",), ("y_L",), ("q_Q",)], "stem string"), frame([("b", "z"), ("b", "y"), ("a", "z")], "iso string, other string"), frame([("c", "L", "n_L", 1), ("c", "L", "q_Q", 2)], "iso string, script string, stem string, ord int"))
    assert {r.iso: r.stem for r in found.collect()} == {"a": "a_L", "b": "y_L", "c": "q_Q", "d": None}
    (tmp_path / "one.txt").write_text("x\ny")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "*.txt")).collect()] == [("one.txt", "x\ny")]
    every, new = readers.through_cache(frame([("A", "old"), ("Z", "other")], "leaf string, text string"), frame([("A", "raw"), ("B", "raw")], "leaf string, text string"), lambda d: d.withColumn("text", F.upper("text")))
    assert sorted(map(tuple, every.collect())) == [("A", "old"), ("B", "RAW")] and [tuple(r) for r in new.collect()] == [("B", "RAW")]
    (tmp_path / "m.csv").write_text("Filename,Language,Family,Genus\nf1,L1,Altaic,\nf2,L2,,G\n")
    assert sorted((r.Filename, r.Family, r.Genus) for r in readers.metadata(spark, str(tmp_path / "m.csv")).collect()) == [("f1", "Turkic", "Turkic"), ("f2", "NA", "G")]
    writers.json_results(frame([("a", 0.5)], "name string, value double"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("name", "value").collect()] == [("a", 0.5)]


def test_characters(spark):
    w = spark.createDataFrame([("a", 1, "hand"), ("b", 1, "hant"), ("c", 1, "main"), ("d", 1, "hand")], "leaf string, concept int, form string")
    c = {r.leaf: r.cogid for r in characters.single_linkage(w).collect()}
    assert c["a"] == c["b"] == c["d"] != c["c"]
    m = characters.binary_matrix(characters.single_linkage(w))
    assert {r.leaf: r.bits for r in m.collect()} == {"a": "1", "b": "1", "c": "0", "d": "1"}
    assert "NTAX=4 NCHAR=1" in writers.nexus(m) and "<sequence" in writers.sampler_xml(m)


def test_sources(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<r xmlns="u"><seg type="verse" id="v1">old</seg><seg type="verse" id="v1">new <i>b</i></seg><seg type="verse">no id</seg><seg type="note" id="n">x</seg></r>')
    assert [tuple(r) for r in readers.verses(spark, str(tmp_path / "*.xml")).collect()] == [("x.xml", "v1", "new b")]
    (tmp_path / "forms.csv").write_text('Language_ID,Parameter_ID,Form,Segments\nA,1,hand,h a nd\nA,1,palm,p\nB,1,main,m\n')
    cand = spark.createDataFrame([("A",)], "id string")
    assert [(r.leaf, r.form, r.tokens) for r in readers.word_list(spark, str(tmp_path), cand).collect()] == [("A", "hand", ["h", "a", "nd"])]
    (tmp_path / "e.dev").write_text("a\nb\n")
    (tmp_path / "e.devtest").write_text("c\nd\n")
    assert [r.text for r in readers.lines(spark, str(tmp_path / "e"), 1).orderBy("unit_id").collect()] == ["a", "c"]
    assert readers.nexus_newick("#NEXUS\nbegin trees;\ntranslate 1 A_x, 2 B;\ntree t = [&R] (1:0.5[&r=1],2:0.5);\nend;") == "(A_x:0.5,B:0.5);"
    lang = spark.createDataFrame([("f", None, None), ("g", "f", None), ("l", "g", "eng")], "id string, parent_id string, iso string")
    assert {(r.depth, r.ancestor) for r in readers.lineages(spark, lang).collect()} == {(0, "l"), (1, "g"), (2, "f")}
    t = spark.createDataFrame([("a", "x")], "leaf string, text string")
    writers.cache(t, str(tmp_path / "cache"), "cap10")
    assert readers.cached(spark, str(tmp_path / "cache"), "cap10").collect() == t.collect()


def test_stream(spark, tmp_path):
    from tessera.streaming.profiles import running_profile

    spark.createDataFrame([("a", "Ab!ab")], "leaf string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("leaf string, text string").json(str(tmp_path / "in"))
    assert stream.isStreaming
    q = running_profile(stream, 2).writeStream.outputMode("complete").format("memory").queryName("prof").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.gram, r.c) for r in spark.table("prof").collect()} == {("ab", 2), ("b ", 1), (" a", 1)}


def test_windowed_stream(spark, tmp_path):
    """Windows of event time; what comes later than the delay is left out."""
    import json
    import os

    from tessera.streaming.profiles import windowed_profile

    (tmp_path / "in").mkdir()
    kind = "ts timestamp, leaf string, text string"
    stream = windowed_profile(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), 1, "1 hour", "1 hour")
    for k, rows in enumerate(([("2024-01-01 00:10:00", "a", "x")], [("2024-01-01 09:10:00", "a", "y")], [("2024-01-01 09:15:00", "a", "z")], [("2024-01-01 00:20:00", "a", "late"), ("2024-01-01 09:20:00", "a", "y")])):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("".join(json.dumps({"ts": t.replace(" ", "T"), "leaf": leaf, "text": x}) + "\n" for t, leaf, x in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    q = stream.writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(str(r.window.start), r.gram): r.c for r in spark.table("windows").orderBy("c").collect()}
    assert got == {("2024-01-01 00:00:00", "x"): 1, ("2024-01-01 09:00:00", "y"): 2, ("2024-01-01 09:00:00", "z"): 1}


@pytest.mark.parametrize("most", [3, 7, 1 << 22])
@pytest.mark.parametrize("n", [1, 3, 4])
def test_grams_are_counted_before_they_are_rows(spark, n, most):
    from collections import Counter

    texts = ["", "a", "ab", "abc abc", "x" * 40, "😀b𝔘 é\0\0", "日本語 日本語", "abcabc" * 5]
    leaf = [k % 3 for k in range(len(texts))]
    want = Counter((x, t[k : k + n]) for x, t in zip(leaf, texts, strict=True) for k in range(len(t) - n + 1))
    for limits in ({}, {"table": 0}, {"most": 1}):
        got = Counter()
        for own, parts in profiles.slices(leaf, texts, n, most):
            assert sum(map(len, parts)) <= 2 * most + n
            for x, g, c in zip(*tx.gram_counts(own, parts, n, **limits), strict=True):
                got[int(x), g] += int(c)
        assert got == want
    df = spark.createDataFrame([*zip(leaf, texts, strict=True), (None, "abcd"), (1, None)], "leaf int, text string")
    got = profiles.profile(df, n)
    assert {(r.leaf, r.gram): r.c for r in got.collect()} == want | Counter((None, "abcd"[k : k + n]) for k in range(5 - n))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each n-gram


def test_shuffled_by_the_same_draws():
    import random

    for n in [*range(40), 127, 128, 129, 1000, 4097]:
        for seed in (0, 5):
            x = [chr(0x4E00 + k) for k in range(n)]
            random.Random(seed).shuffle(x)
            assert tx.shuffled("".join(chr(0x4E00 + k) for k in range(n)), seed) == "".join(x)


def test_block_replicates_by_tiles(spark, monkeypatch):
    rows = [(f"l{k % 5}", k // 2, "abc" * (k % 4) + " xyzé 日本" * (k % 3)) for k in range(20)] + [("only", 3, "abcx"), ("none", 1, "ab")]
    units = spark.createDataFrame(rows, "leaf string, unit_id int, text string")
    each = units.select("leaf", "unit_id", F.explode(tx.ngrams(F.col("text"), 3)).alias("gram"))
    counts = each.join(inference.unit_weights(units, 5), "unit_id").groupBy("rep", "leaf", "gram").agg(F.sum("w").alias("c"))
    want = {(r.rep, r.i, r.j): r.d for r in inference._js_by(counts).collect()}
    for name, value in (("REPS_A_TASK", 2), ("LEAVES_A_TASK", 2), ("AT_ONCE", 3)):
        monkeypatch.setattr(inference, name, value)
    got = {(r.rep, r.i, r.j): r.d for r in inference.block_replicates(units, 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
