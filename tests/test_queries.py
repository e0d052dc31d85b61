"""The registered queries that DuckDB can express give the same rows on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(v[k]) for k in order) for v in values), key=str)


@pytest.mark.parametrize("name", ["joined_ngram_counts", "capped_ngram_counts", "js_lidstone", "perplexity_distance", "jaccard_alphabet", "conditional_ladder", "cognate_distance", "flagship", "gqd_from_splits", "rf_from_splits", "common_units", "grassberger", "containing_clade", "mantel_p", "block_bootstrap", "binary_matrix", "genealogy_splits", "delta_by_clade", "line_files", "text_parts"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(q.SQL[name])
    columns = [c[0] for c in want.description]
    got = q.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
