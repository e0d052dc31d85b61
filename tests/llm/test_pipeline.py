"""The pipeline's rows against a brute-force run of its stages on a small fixture."""

from collections import defaultdict

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_links, corpus


def test_pipeline(spark, tmp_path):
    rows = corpus() + [(200 + i, f"common header line\nown words number {i} are here and there", "en", f"s{i}", 1, "x", "y", "z") for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    leak = " ".join(rows[8][1].split()[:15])
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r[0]: (r[1], r[3]) for r in rows if any(c.isalpha() for c in r[1] or "")}
    sites, first = defaultdict(set), {}
    for i, (t, s) in sorted(kept.items()):
        for p, x in enumerate(t.split("\n")):
            if x.strip():
                sites[x.strip()].add(s)
                first.setdefault(x.strip(), (i, p))
    cut = {}
    for i, (t, s) in kept.items():
        lines = [x for p, x in enumerate(t.split("\n")) if not x.strip() or len(sites[x.strip()]) < 10 or first[x.strip()] == (i, p)]
        if any(x.strip() for x in lines):
            cut[i] = "\n".join(lines)
    classes = brute_links(list(cut.items()))
    single = {i: t for i, t in cut.items() if classes[i][0] == i}
    want = {i: t for i, t in single.items() if not any(" ".join(leak.split()[k : k + 10]) in " ".join(t.split()) for k in range(6))}
    assert {r.doc_id for r in got} <= set(want) and all(r.text == want[r.doc_id] for r in got)
    assert {8} & set(single) and 8 not in want
    size = sum(len(t.split()) for t in want.values())
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * size) <= 0.5 * sum(sorted(len(t.split()) for t in want.values())[-16:])
    assert [r.position for r in got] == sorted(r.position for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_identify_without_lang(spark, tmp_path):
    """If no row has a lang, texts with a letter stay."""
    rows = [(1, "some clean text", None), (2, "12 34 !!", None), (3, None, None), (4, "É", None)]
    docs = spark.createDataFrame([(i, t, g, "s", 1, "x", "y", "z") for i, t, g in rows], SCHEMA)
    got = corpus_pipeline.identify(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(1, "und"), (4, "und")]
    assert corpus_pipeline.identify(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    """Empty documents, and a benchmark without rows, give an empty mix with its columns."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[-2:] == ["copy", "position"]


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, and ids that repeat with other texts: each text that is clean comes out."""
    rows = [(1, "one clean text of words", "en", "a", 1, "x", "y", "z"), (1, "another clean text with its words", "en", "a", 1, "x", "y", "z"), (1, "one clean text of words", "en", "a", 1, "x", "y", "z"), (None, "a text without id stays too", None, None, None, None, None, None), (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "x", "y", "z")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "leaked words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(1, rows[0][1]), (1, rows[1][1]), (None, rows[3][1])], key=str)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {(r[0], r[1]) for r in rows}
