"""The engine's queries over the test tables, each with the same query as SQL where SQL can express it.

Leaves are lang_source of documents, their family is lang and their units are documents. Doubles are rounded to 6 places, and
distances to 9 places before neighbours are chosen, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import characters, distances, inference, neighbors, profiles, quartets, trees
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def units(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("lang is not null and source is not null and text is not null")
    return t.select(F.concat_ws("_", "lang", "source").alias("leaf"), F.col("lang").alias("family"), "source", F.col("doc_id").alias("unit_id"), tx.clean_sql(F.col("text")).alias("text"))


def leaves(spark: SparkSession, d: str, group: str = "family") -> DataFrame:
    t = table(spark, d, "documents").where("lang is not null and source is not null and text is not null")
    return t.select(F.concat_ws("_", "lang", "source").alias("leaf"), F.col("lang").alias("family"), "source").distinct().select("leaf", F.col(group).alias("group"))


def grams(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    return profiles.profile(units(spark, d), n)


def brands(spark: SparkSession, d: str) -> DataFrame:
    """Word lists: brand, size as concept, name of the least part key as form."""
    t = table(spark, d, "part").select(F.col("p_brand").alias("leaf"), F.col("p_size").alias("concept"), F.col("p_name").alias("form"), "p_partkey")
    return readers.first_synonyms(t, "p_partkey")


def js9(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    return distances.js(grams(spark, d, n)).withColumn("d", F.round("d", 9))


CLEAN = r"trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), chr(775), ''), '[^\p{L}\p{M}]+', ' ', 'g'))"
U = f"u AS (SELECT doc_id, lang || '_' || source AS leaf, lang AS family, source, {CLEAN} AS t FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL), "
CH = "ch AS (SELECT doc_id, leaf, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT doc_id, leaf, string_split(t, '') AS cs FROM u WHERE t <> '')), "


def gram_sql(n: int, name: str = "p") -> str:
    parts = " || ".join(["c", *(f"lead(c, {k}) OVER w" for k in range(1, n))])
    return f"{name} AS (SELECT leaf, gram, count(*) AS c FROM (SELECT leaf, {parts} AS gram FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL GROUP BY 1, 2), "


PAIRS = "lv AS (SELECT DISTINCT leaf FROM p), pr AS (SELECT a.leaf AS i, b.leaf AS j FROM lv a JOIN lv b ON a.leaf < b.leaf), "
JS = """s AS (SELECT leaf, gram, c / sum(c) OVER (PARTITION BY leaf) AS p FROM p),
o AS (SELECT a.leaf AS i, b.leaf AS j, sum(0.5 * a.p * log2(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * log2(b.p / ((a.p + b.p) / 2)) - (a.p + b.p) / 2) AS s FROM s a JOIN s b ON a.gram = b.gram AND a.leaf < b.leaf GROUP BY 1, 2),
d AS (SELECT i, j, sqrt(greatest(0.0, 1.0 + coalesce(s, 0.0))) AS d FROM pr LEFT JOIN o USING (i, j)), """
D3 = f"WITH {U}{CH}{gram_sql(3)}{PAIRS}{JS}"
NN = """d9 AS (SELECT i, j, round(d, 9) AS d FROM d), sy AS (SELECT i, j, d FROM d9 UNION ALL SELECT j, i, d FROM d9),
nn AS (SELECT i, min(j) AS j, any_value(m) AS d, count(*) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY i) AS m FROM sy) WHERE d <= m + 1e-9 GROUP BY i), """
G = "g AS (SELECT DISTINCT leaf, family AS grp FROM u), "


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def ngram_counts(spark, d):
    return grams(spark, d)


JU = "ju AS (SELECT leaf, string_agg(t, ' ' ORDER BY doc_id) AS t FROM u WHERE t <> '' GROUP BY leaf), "
JC = "ch AS (SELECT leaf AS doc_id, leaf, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT leaf, string_split(t, '') AS cs FROM ju)), "


@query(f"WITH {U}{JU}{JC}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def joined_ngram_counts(spark, d):
    return profiles.joined_profile(units(spark, d))


@query(f"WITH {U}{JU}{JC}{gram_sql(1)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def joined_unigram_counts(spark, d):
    return profiles.joined_profile(units(spark, d), 1)


@query(f"WITH {U}{JU.replace('string_agg(t, ' + chr(39) + ' ' + chr(39) + ' ORDER BY doc_id)', 'rtrim(left(string_agg(t, ' + chr(39) + ' ' + chr(39) + ' ORDER BY doc_id), 30000))')}{JC}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def capped_ngram_counts(spark, d):
    return profiles.joined_profile(profiles.capped_units(units(spark, d), 30_000))


@query(f"WITH {U}{JU}x AS (SELECT min(length(t)) AS n FROM ju) SELECT leaf, md5(left(t, n)) AS text FROM ju, x")
def equalized_texts(spark, d):
    return profiles.equalized(profiles.joined_units(units(spark, d))).select("leaf", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"WITH {U}{CH}{gram_sql(1)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def shuffled_unigram_counts(spark, d):
    """A permutation of characters leaves their counts as they are."""
    return profiles.profile(units(spark, d).withColumn("text", tx.shuffle_chars(0)(F.col("text"))), 1)


@query(f"WITH {U}{CH}{gram_sql(1)}x AS (SELECT 1) SELECT leaf, gram, c FROM p")
def unigram_counts(spark, d):
    return grams(spark, d, 1)


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT DISTINCT gram FROM p")
def global_vocabulary(spark, d):
    return profiles.vocabulary(grams(spark, d))


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, count(*) AS k, sum(c)::BIGINT AS n FROM p GROUP BY leaf")
def vocab_size_kn(spark, d):
    return profiles.sizes(grams(spark, d))


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, count(*) AS k, sum(c)::BIGINT AS n, round(count(*) / sum(c), 6) AS ratio, count(*) / sum(c) > 0.3 AS sparse FROM p GROUP BY leaf")
def sparsity_flag(spark, d):
    return rounded(profiles.sparse(grams(spark, d)))


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, gram, round(c / sum(c) OVER (PARTITION BY leaf), 6) AS p FROM p")
def ngram_shares(spark, d):
    return rounded(profiles.probabilities(grams(spark, d)).select("leaf", "gram", "p"))


H = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, round({H}, 6) AS h FROM p GROUP BY leaf")
def block_entropy(spark, d):
    return rounded(profiles.block_entropy(grams(spark, d)))


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, round({H} + (count(*) - 1) / (2 * sum(c) * ln(2)), 6) AS h FROM p GROUP BY leaf")
def miller_madow(spark, d):
    return rounded(profiles.block_entropy(grams(spark, d), "mm"))


#: The estimator's terms by their recurrence: G(1) = -gamma - ln 2, G(2 m) = G(2 m + 1) = G(1) + 2 (1 + 1/3 + ... + 1/(2 m - 1)).
GR = """t AS (SELECT 0 AS m, 0.0::DOUBLE AS s UNION ALL SELECT m, sum(2.0::DOUBLE / (2 * m - 1)) OVER (ORDER BY m) FROM (SELECT unnest(range(1, (SELECT max(c) // 2 + 1 FROM p))) AS m)) """


@query(f"WITH {U}{CH}{gram_sql(3)}{GR}SELECT leaf, round((ln(sum(c)) - sum(c * (s - 0.5772156649015329 - ln(2))) / sum(c)) / ln(2), 6) AS h FROM p JOIN t ON m = c // 2 GROUP BY leaf")
def grassberger(spark, d):
    return rounded(profiles.block_entropy(grams(spark, d), "grassberger"))


@query(f"WITH {U}{CH}{''.join(gram_sql(n, f'p{n}') for n in range(1, 5))}h AS ({' UNION ALL '.join(f'SELECT leaf, {n} AS n, {H} AS h FROM p{n} GROUP BY leaf' for n in range(1, 5))}) SELECT leaf, n, round(h, 6) AS h, round(h - lag(h, 1, 0.0) OVER (PARTITION BY leaf ORDER BY n), 6) AS f FROM h")
def conditional_ladder(spark, d):
    return rounded(profiles.ladder(units(spark, d)))


ES = f"""WITH x AS (SELECT n, unnest(range(n * 200)) AS id FROM (SELECT unnest([128, 1024, 16384]) AS n)),
p AS (SELECT n, id // n AS rep, ('0x' || substr(md5('0:' || n || ':' || id), 1, 15))::BIGINT % 64 AS g, count(*) AS c FROM x GROUP BY ALL), {GR},
e AS (SELECT n, rep, {H} AS a, {H} + (count(*) - 1) / (2 * sum(c) * ln(2)) AS b, (ln(sum(c)) - sum(c * (s - 0.5772156649015329 - ln(2))) / sum(c)) / ln(2) AS g FROM p JOIN t ON m = c // 2 GROUP BY n, rep)
SELECT n::INT AS n, estimator, round(avg(h), 6) AS h FROM (SELECT n, 'plugin' AS estimator, a AS h FROM e UNION ALL SELECT n, 'mm', b FROM e UNION ALL SELECT n, 'grassberger', g FROM e) GROUP BY n, estimator"""


@query(ES)
def entropy_simulation(spark, d):
    return rounded(profiles.entropy_simulation(spark))


@query(f"{D3}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM d")
def js_trigram(spark, d):
    return rounded(distances.js(grams(spark, d)))


@query(f"WITH {U}{JU}{JC}{gram_sql(3)}{PAIRS}{JS}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM d")
def js_trigram_joined(spark, d):
    return rounded(distances.js(profiles.joined_profile(units(spark, d))))


@query(f"WITH {U}{CH}{gram_sql(1)}{PAIRS}{JS}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM d")
def js_unigram(spark, d):
    return rounded(distances.js(grams(spark, d, 1)))


LID = """z AS (SELECT leaf, count(*) AS k, sum(c) AS n FROM p GROUP BY leaf),
bo AS (SELECT a.leaf AS i, b.leaf AS j, a.c AS x, b.c AS y, count(*) AS m FROM p a JOIN p b ON a.gram = b.gram AND a.leaf < b.leaf GROUP BY ALL),
ab AS (SELECT pr.i, pr.j, zi.n AS ni, zj.n AS nj, zi.k + zj.k - coalesce(b, 0) AS k FROM pr JOIN z zi ON zi.leaf = pr.i JOIN z zj ON zj.leaf = pr.j LEFT JOIN (SELECT i, j, sum(m) AS b FROM bo GROUP BY 1, 2) USING (i, j)),
hs AS (SELECT leaf, c, count(*) AS m FROM p GROUP BY 1, 2),
tm AS (SELECT i, j, x, y, m, 1.0 AS w FROM bo UNION ALL SELECT i, j, x, 0, m, -1.0 FROM bo UNION ALL SELECT i, j, 0, y, m, -1.0 FROM bo
  UNION ALL SELECT i, j, c, 0, m, 1.0 FROM hs JOIN pr ON leaf = i UNION ALL SELECT i, j, 0, c, m, 1.0 FROM hs JOIN pr ON leaf = j),
pq AS (SELECT i, j, m * w AS m, (x + 0.3) / (ni + 0.3 * k) AS p, (y + 0.3) / (nj + 0.3 * k) AS q FROM tm JOIN ab USING (i, j)) """


@query(f"WITH {U}{CH}{gram_sql(3)}{PAIRS}{LID}SELECT i, j, round(sqrt(greatest(0.0, sum(m * (0.5 * p * log2(p / ((p + q) / 2)) + 0.5 * q * log2(q / ((p + q) / 2)))))), 6) AS d FROM pq GROUP BY i, j")
def js_lidstone(spark, d):
    return rounded(distances.js(grams(spark, d), 0.3))


JA = """k AS (SELECT leaf, count(*) AS k FROM p WHERE gram <> ' ' GROUP BY leaf), b AS (SELECT a.leaf AS i, b.leaf AS j, count(*) AS b FROM p a JOIN p b ON a.gram = b.gram AND a.leaf < b.leaf WHERE a.gram <> ' ' GROUP BY 1, 2)
SELECT i, j, round(CASE WHEN coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(b, 0) = 0 THEN 0.0 ELSE 1 - coalesce(b, 0) / (coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(b, 0)) END, 6) AS d FROM pr LEFT JOIN k x ON x.leaf = i LEFT JOIN k y ON y.leaf = j LEFT JOIN b USING (i, j)"""


@query(f"WITH {U}{CH}{gram_sql(1)}{PAIRS}{JA}")
def jaccard_alphabet(spark, d):
    return rounded(distances.jaccard(grams(spark, d, 1)))


PP = """gr AS (SELECT leaf, gram, c, gram[1:2] AS ctx FROM p), v AS (SELECT greatest(count(DISTINCT ch), 2) AS v FROM (SELECT unnest(string_split(gram, '')) AS ch FROM p)),
mo AS (SELECT leaf AS m, ctx, sum(c) AS tot FROM gr GROUP BY 1, 2), n AS (SELECT leaf, sum(c) AS n FROM gr GROUP BY 1),
kn AS (SELECT g.leaf, mo.m, sum(-g.c * log2((coalesce(o.c, 0) + 0.1) / (tot + 0.1 * v))) AS bits, sum(g.c) AS known FROM gr g JOIN mo ON g.ctx = mo.ctx LEFT JOIN gr o ON o.leaf = mo.m AND o.gram = g.gram, v GROUP BY 1, 2),
ce AS (SELECT a.leaf, b.leaf AS m, (coalesce(bits, 0) + (a.n - coalesce(known, 0)) * log2(v)) / a.n AS ce FROM n a CROSS JOIN n b CROSS JOIN v LEFT JOIN kn ON kn.leaf = a.leaf AND kn.m = b.leaf)
SELECT least(x.leaf, x.m) AS i, greatest(x.leaf, x.m) AS j, round(greatest(0.0, sum(x.ce - y.ce) / 2), 6) AS d FROM ce x JOIN ce y ON y.leaf = x.leaf AND y.m = x.leaf WHERE x.leaf <> x.m GROUP BY 1, 2"""


@query(f"WITH {U}{CH}{gram_sql(3)}{PP}")
def perplexity_distance(spark, d):
    return rounded(distances.perplexity(grams(spark, d)))


W = "w AS (SELECT p_brand AS leaf, p_size AS concept, arg_min(p_name, p_partkey) AS form FROM part GROUP BY 1, 2), "
WP = "pr AS (SELECT a.leaf AS i, b.leaf AS j FROM (SELECT DISTINCT leaf FROM w) a JOIN (SELECT DISTINCT leaf FROM w) b ON a.leaf < b.leaf), "
WD = "wd AS (SELECT a.leaf AS i, b.leaf AS j, avg(levenshtein(a.form, b.form) / greatest(length(a.form), length(b.form))) AS d, count(*) AS shared FROM w a JOIN w b ON a.concept = b.concept AND a.leaf < b.leaf GROUP BY 1, 2), d AS (SELECT i, j, coalesce(d, 1.0) AS d, coalesce(shared, 0) AS shared FROM pr LEFT JOIN wd USING (i, j)) "


@query(f"WITH {W}{WP}{WD}SELECT i, j, round(d, 6) AS d, shared FROM d")
def wordlist_levenshtein(spark, d):
    return rounded(distances.word_lists(brands(spark, d)))


@query(f"{D3}{NN}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM nn")
def nn_first(spark, d):
    return rounded(neighbors.nearest(js9(spark, d)).select("i", "j", "d"))


@query(f"WITH {U}{CH}{gram_sql(1)}{PAIRS}k AS (SELECT leaf, count(*) AS k FROM p WHERE gram <> ' ' GROUP BY leaf), b AS (SELECT a.leaf AS i, b.leaf AS j, count(*) AS b FROM p a JOIN p b ON a.gram = b.gram AND a.leaf < b.leaf WHERE a.gram <> ' ' GROUP BY 1, 2), d AS (SELECT i, j, 1 - coalesce(b, 0) / (x.k + y.k - coalesce(b, 0)) AS d FROM pr JOIN k x ON x.leaf = i JOIN k y ON y.leaf = j LEFT JOIN b USING (i, j)), {NN}x AS (SELECT 1) SELECT i, j, ties FROM nn")
def nn_ties(spark, d):
    return neighbors.nearest(distances.jaccard(grams(spark, d, 1)).withColumn("d", F.round("d", 9))).select("i", "j", "ties")


def purity_sql(hit: str) -> str:
    return f"{D3}{NN}{G}x AS (SELECT a.grp = b.grp AS hit, ties FROM nn JOIN g a ON a.leaf = i JOIN g b ON b.leaf = j) SELECT round(avg({hit}), 6) AS purity, count({hit}) AS n, count(*) FILTER (WHERE ties > 1) AS n_ties FROM x"


@query(purity_sql("hit::INT"))
def purity_first(spark, d):
    return rounded(neighbors.purity(js9(spark, d), leaves(spark, d)))


@query(purity_sql("(hit AND ties = 1)::INT"))
def purity_miss(spark, d):
    return rounded(neighbors.purity(js9(spark, d), leaves(spark, d), "miss"))


@query(purity_sql("CASE WHEN ties = 1 THEN hit::INT END"))
def purity_drop(spark, d):
    return rounded(neighbors.purity(js9(spark, d), leaves(spark, d), "drop"))


@query(f"{D3}{NN}g AS (SELECT DISTINCT leaf, source AS grp FROM u), x AS (SELECT a.grp = b.grp AS hit FROM nn JOIN g a ON a.leaf = i JOIN g b ON b.leaf = j) SELECT round(avg(hit::INT), 6) AS purity FROM x")
def purity_by_source(spark, d):
    return rounded(neighbors.purity(js9(spark, d), leaves(spark, d, "source")).select("purity"))


@query(f"{D3}ds AS (SELECT * FROM d WHERE i NOT LIKE 'en\\_%' ESCAPE '\\' AND j NOT LIKE 'en\\_%' ESCAPE '\\'), {NN.replace('FROM d)', 'FROM ds)')}{G}x AS (SELECT a.grp = b.grp AS hit FROM nn JOIN g a ON a.leaf = i JOIN g b ON b.leaf = j) SELECT round(avg(hit::INT), 6) AS purity, count(*) AS n FROM x")
def subset_purity(spark, d):
    g = leaves(spark, d)
    return rounded(neighbors.subset_purity(js9(spark, d), g, g.where("group <> 'en'").select("leaf")).select("purity", "n"))


@query(f"WITH {U}{G}m AS (SELECT grp, count(*) AS m FROM g GROUP BY grp) SELECT round(sum(m * (m - 1)) / (sum(m) * (sum(m) - 1)), 6) AS chance FROM m")
def chance_floor(spark, d):
    return rounded(neighbors.chance_floor(leaves(spark, d)))


@query(f"{D3}k AS (SELECT leaf, count(*) AS k FROM p GROUP BY leaf) SELECT round(corr(d, greatest(a.k, b.k)), 6) AS r_max, round(corr(d, abs(a.k - b.k)), 6) AS r_diff FROM d JOIN k a ON a.leaf = i JOIN k b ON b.leaf = j")
def bias_corr(spark, d):
    p = grams(spark, d)
    return rounded(neighbors.bias(distances.js(p), profiles.sizes(p)))


@query(f"{D3}x AS (SELECT quantile_cont(d, [0.025, 0.5, 0.975]) AS q FROM d) SELECT round(q[1], 6) AS lo, round(q[2], 6) AS med, round(q[3], 6) AS hi FROM x")
def distance_percentiles(spark, d):
    return rounded(neighbors.spread_of(distances.js(grams(spark, d))))


@query(f"{D3}{G}{NN}q AS (SELECT a.grp = b.grp AS hit, ties FROM nn JOIN g a ON a.leaf = i JOIN g b ON b.leaf = j), m AS (SELECT grp, count(*) AS m FROM g GROUP BY grp) SELECT round(avg(hit::INT), 6) AS purity, round(avg((hit AND ties = 1)::INT), 6) AS purity_tiemiss, count(*) FILTER (WHERE ties > 1) AS n_ties, count(*) AS n, (SELECT round(sum(m * (m - 1)) / (sum(m) * (sum(m) - 1)), 6) FROM m) AS chance FROM q")
def flagship(spark, d):
    """Documents to trigram profiles, distances, neighbours and their purity against chance."""
    return rounded(neighbors.diagnostics(js9(spark, d), leaves(spark, d)))


def nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("leaf"), F.col("r_name").alias("family"), F.substring("n_name", 8, 1).alias("initial"))  # of NATION_12: 1, which cuts across regions


#: Average linkage of d9 (i, j, d), step by step: ut has the distances of all live clusters before each step, mg the merges, an each leaf's clusters.
UPGMA = """d9 AS (SELECT i, j, round(d, 9) AS d FROM d), lf AS (SELECT leaf, row_number() OVER (ORDER BY leaf) - 1 AS id FROM lv), nl AS (SELECT count(*) AS n FROM lf),
ut(step, i, j, d, si, sj) AS (SELECT 0::BIGINT, a.id, b.id, d9.d, 1::BIGINT, 1::BIGINT FROM d9 JOIN lf a ON a.leaf = d9.i JOIN lf b ON b.leaf = d9.j
UNION ALL SELECT * FROM (WITH mn AS (SELECT any_value(step) AS s, arg_min(i, (d, i, j)) AS a, arg_min(j, (d, i, j)) AS b, arg_min(si, (d, i, j)) AS sa, arg_min(sj, (d, i, j)) AS sb FROM ut)
SELECT step + 1, i, j, d, si, sj FROM ut, mn WHERE i NOT IN (a, b) AND j NOT IN (a, b)
UNION ALL SELECT s + 1, x, (SELECT n FROM nl) + s, (sa * max(d) FILTER (o = a) + sb * max(d) FILTER (o = b)) / (sa + sb), max(sx), sa + sb
FROM (SELECT CASE WHEN i IN (a, b) THEN j ELSE i END AS x, CASE WHEN i IN (a, b) THEN i ELSE j END AS o, CASE WHEN i IN (a, b) THEN sj ELSE si END AS sx, d, s, a, b, sa, sb FROM ut, mn WHERE (i IN (a, b)) <> (j IN (a, b))) GROUP BY x, s, a, b, sa, sb)),
mg AS (SELECT step, arg_min(i, (d, i, j)) AS l, arg_min(j, (d, i, j)) AS r, min(d) AS h, arg_min(si + sj, (d, i, j)) AS size FROM ut GROUP BY step),
an(leaf, node, step, path) AS (SELECT leaf, id, -1::BIGINT, '' FROM lf UNION ALL SELECT an.leaf, nl.n + mg.step, mg.step, CASE WHEN mg.l = an.node THEN '0' ELSE '1' END || an.path FROM an JOIN mg ON an.node IN (mg.l, mg.r), nl), """
UD3 = D3.replace("WITH ", "WITH RECURSIVE ", 1) + UPGMA


GS = """t AS (SELECT n_name AS leaf, r_name AS family, n_name[8] AS initial FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT count(*) AS n FROM t),
sp(lv, split) AS (SELECT 'family', list(leaf ORDER BY leaf) FROM t GROUP BY family UNION ALL SELECT 'initial', list(leaf ORDER BY leaf) FROM t GROUP BY initial),
gs AS (SELECT DISTINCT lv, CASE WHEN len(split) * 2 <= n THEN split ELSE (SELECT list(leaf ORDER BY leaf) FROM t WHERE NOT list_contains(split, leaf)) END AS split FROM sp, n WHERE len(split) >= 2 AND n - len(split) >= 2) """


@query(f"WITH {GS}SELECT array_to_string(split, '|') AS split FROM gs WHERE lv = 'family'")
def gold_splits(spark, d):
    return trees.gold_splits(nations(spark, d), "family").select(F.array_join("split", "|").alias("split"))


@query(f"WITH {GS}, a AS (SELECT split FROM gs WHERE lv = 'family'), b AS (SELECT split FROM gs WHERE lv = 'initial') SELECT round(((SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a))) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS rf")
def rf_from_splits(spark, d):
    n = nations(spark, d)
    return rounded(trees.rf(trees.gold_splits(n, "family"), trees.gold_splits(n, "initial")))


GQ = """, q AS (SELECT a.leaf AS a, b.leaf AS b, c.leaf AS c, e.leaf AS e FROM t a JOIN t b ON a.leaf < b.leaf JOIN t c ON b.leaf < c.leaf JOIN t e ON c.leaf < e.leaf),
x AS (SELECT a, b, c, e, lv, min(CASE WHEN ia = ib THEN b WHEN ia = ic THEN c ELSE e END) AS p FROM (SELECT q.*, lv, list_contains(split, a) AS ia, list_contains(split, b) AS ib, list_contains(split, c) AS ic, list_contains(split, e) AS ie FROM q, gs) WHERE ia::INT + ib::INT + ic::INT + ie::INT = 2 GROUP BY ALL),
y AS (SELECT q.*, g.p AS g, i.p AS i FROM q LEFT JOIN x g ON g.lv = 'family' AND (g.a, g.b, g.c, g.e) = (q.a, q.b, q.c, q.e) LEFT JOIN x i ON i.lv = 'initial' AND (i.a, i.b, i.c, i.e) = (q.a, q.b, q.c, q.e))
SELECT round(avg((g IS DISTINCT FROM i)::INT) FILTER (WHERE g IS NOT NULL), 6) AS gqd, count(g) AS resolved_in_gold, count(*) AS n, false AS approx FROM y"""


@query(f"WITH {GS}{GQ}")
def gqd_from_splits(spark, d):
    n = nations(spark, d)
    return rounded(quartets.gqd(quartets.quartets(n.select("leaf")), trees.gold_splits(n, "initial"), trees.gold_splits(n, "family")))


@query(f"WITH {GS}, i AS (SELECT right(leaf, 1) AS grp, list(leaf ORDER BY leaf) AS members FROM t GROUP BY grp) SELECT grp AS \"group\", arg_min(array_to_string(split, '|'), (len(split), split)) AS clade, min(len(split))::INT AS size, min(len(split)) = any_value(len(members)) AS exact FROM i JOIN gs ON list_has_all(split, members) GROUP BY grp")
def containing_clade(spark, d):
    n = nations(spark, d)
    found = trees.containing_clade(n.select("leaf", F.right("leaf", F.lit(1)).alias("group")), trees.gold_splits(n, "family").unionByName(trees.gold_splits(n, "initial")))
    return found.where("clade is not null").withColumn("clade", F.array_join("clade", "|"))


DL = """lf AS (SELECT DISTINCT leaf FROM w), q AS (SELECT a.leaf AS a, b.leaf AS b, c.leaf AS c, e.leaf AS e FROM lf a JOIN lf b ON a.leaf < b.leaf JOIN lf c ON b.leaf < c.leaf JOIN lf e ON c.leaf < e.leaf),
s AS (SELECT list_sort([ab.d + ce.d, ac.d + be.d, ae.d + bc.d]) AS s FROM q JOIN d ab ON (ab.i, ab.j) = (a, b) JOIN d ac ON (ac.i, ac.j) = (a, c) JOIN d ae ON (ae.i, ae.j) = (a, e) JOIN d bc ON (bc.i, bc.j) = (b, c) JOIN d be ON (be.i, be.j) = (b, e) JOIN d ce ON (ce.i, ce.j) = (c, e))
SELECT round(avg(CASE WHEN s[3] - s[1] <= 1e-12 THEN 0.0 ELSE (s[3] - s[2]) / (s[3] - s[1]) END), 6) AS delta, count(*) AS n FROM s"""


@query(f"WITH {W}{WP}{WD}, {DL}")
def quartet_delta(spark, d):
    w = brands(spark, d)
    return rounded(quartets.delta(quartets.quartets(w.select("leaf")), distances.word_lists(w)))


@query(f"WITH {U}{CH}{gram_sql(3)}{PAIRS}{JS}p1 AS (SELECT leaf, c AS gram, count(*) AS c FROM ch GROUP BY 1, 2), s1 AS (SELECT leaf, gram, c / sum(c) OVER (PARTITION BY leaf) AS p FROM p1), {JS.split('),', 1)[1].replace('o AS', 'o1 AS').replace('FROM s a JOIN s b', 'FROM s1 a JOIN s1 b').replace('d AS (', 'd1 AS (').replace('JOIN o ', 'JOIN o1 ')}x AS (SELECT 1) SELECT round(corr(d.d, d1.d), 6) AS r FROM d JOIN d1 USING (i, j)")
def mantel_r(spark, d):
    a, b = distances.js(grams(spark, d)), distances.js(grams(spark, d, 1)).withColumnRenamed("d", "e")
    return rounded(a.join(b, ["i", "j"]).agg(F.corr("d", "e").alias("r")))


MANTEL = SQL["mantel_r"].partition("x AS (SELECT 1) SELECT")[0]
PERM = """m AS (SELECT i, j, d.d AS x, d1.d AS y FROM d JOIN d1 USING (i, j)),
pm AS (SELECT rep, leaf, row_number() OVER (PARTITION BY rep ORDER BY leaf) AS place, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep > 0 THEN md5('0:' || rep || ':' || leaf) ELSE '' END, leaf) AS drawn FROM lv, (SELECT unnest(range(1000)) AS rep)),
po AS (SELECT a.rep, a.leaf, b.leaf AS other FROM pm a JOIN pm b ON a.rep = b.rep AND a.place = b.drawn), fy AS (SELECT i, j, y FROM m UNION ALL SELECT j, i, y FROM m),
k AS (SELECT leaf, count(*) AS k FROM p GROUP BY leaf), z AS (SELECT i, j, x, abs(a.k - b.k)::DOUBLE AS z FROM m JOIN k a ON a.leaf = i JOIN k b ON b.leaf = j), f AS (SELECT regr_slope(x, z) AS b, regr_intercept(x, z) AS a FROM z),
t AS (SELECT a.rep, z.x, z.z, x - f.a - f.b * z.z AS ex, fy.y FROM po a JOIN po b ON a.rep = b.rep JOIN z ON z.i = a.leaf AND z.j = b.leaf JOIN fy ON fy.i = a.other AND fy.j = b.other, f), """
P_OF = "SELECT round(max(r0), 6) AS r, round((count(*) FILTER (abs(r) >= abs(r0) - 1e-12) + 1) / 1000, 6) AS p FROM rr, (SELECT r AS r0 FROM rr WHERE rep = 0) WHERE rep > 0"


@query(f"{MANTEL}{PERM}rr AS (SELECT rep, corr(x, y) AS r FROM t GROUP BY rep) {P_OF}")
def mantel_p(spark, d):
    return rounded(inference.mantel(distances.js(grams(spark, d)), distances.js(grams(spark, d, 1))))


@query(f"{MANTEL}{PERM}og AS (SELECT rep, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM t GROUP BY rep), rr AS (SELECT rep, corr(ex, y - a - b * z) AS r FROM t JOIN og USING (rep) GROUP BY rep) {P_OF}")
def partial_mantel(spark, d):
    p = grams(spark, d)
    k = lambda x: profiles.sizes(p).select(F.col("leaf").alias(x), F.col("k").alias(f"k{x}"))
    control = k("i").join(k("j"), F.col("i") < F.col("j")).select("i", "j", F.abs(F.col("ki") - F.col("kj")).cast("double").alias("d"))
    return rounded(inference.partial_mantel(distances.js(p), distances.js(grams(spark, d, 1)), control))


@query(f"WITH {U}{G}x AS (SELECT 1) SELECT a.leaf AS i, b.leaf AS j, CASE WHEN a.grp = b.grp THEN 0.0 ELSE 1.0 END AS d FROM g a JOIN g b ON a.leaf < b.leaf")
def block_matrix(spark, d):
    return distances.blocks(leaves(spark, d))


@query("SELECT conv_id::VARCHAR AS unit_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = (SELECT count(DISTINCT role) FROM conversations)")
def common_units(spark, d):
    return neighbors.common_units(table(spark, d, "conversations").select(F.col("role").alias("leaf"), F.col("conv_id").alias("unit_id")))


@query("SELECT conv_id AS leaf, turn AS unit_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def first_n_units(spark, d):
    return neighbors.first_units(table(spark, d, "conversations").select(F.col("conv_id").alias("leaf"), F.col("turn").alias("unit_id")), 3)


@query("WITH w AS (SELECT p_type AS lang, p_brand AS leaf, count(DISTINCT p_size) AS concepts FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) >= 2) SELECT lang, leaf, concepts FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY concepts DESC, leaf) AS r FROM w) WHERE r = 1")
def best_doculect(spark, d):
    t = table(spark, d, "part").select(F.col("p_type").alias("lang"), F.col("p_brand").alias("leaf"), F.col("p_size").alias("concept"))
    return neighbors.best_doculect(t, "lang", 2)


CG = """WITH RECURSIVE w AS (SELECT p_brand AS leaf, p_size AS concept, arg_min(p_name, p_partkey) AS form FROM part GROUP BY 1, 2), f AS (SELECT DISTINCT concept, form FROM w),
e AS (SELECT a.concept, a.form AS a, b.form AS b FROM f a JOIN f b ON a.concept = b.concept AND (a.form = b.form OR levenshtein(a.form, b.form) / greatest(length(a.form), length(b.form)) < 0.5)),
r(concept, a, b) AS (SELECT * FROM e UNION SELECT r.concept, r.a, e.b FROM r JOIN e ON r.concept = e.concept AND r.b = e.a), k AS (SELECT concept, a AS form, min(b) AS root FROM r GROUP BY 1, 2), c AS (SELECT leaf, concept, root FROM w JOIN k USING (concept, form)), """


@query(f"{CG}{WP}cd AS (SELECT a.leaf AS i, b.leaf AS j, 1 - avg((a.root = b.root)::INT) AS d, count(*) AS shared FROM c a JOIN c b ON a.concept = b.concept AND a.leaf < b.leaf GROUP BY 1, 2) SELECT i, j, round(coalesce(d, 1.0), 6) AS d, coalesce(shared, 0) AS shared FROM pr LEFT JOIN cd USING (i, j)")
def cognate_distance(spark, d):
    return rounded(distances.cognates(characters.single_linkage(brands(spark, d))))


@query(f"{CG}z AS (SELECT concept, root, count(DISTINCT leaf) AS size FROM c GROUP BY 1, 2 HAVING count(DISTINCT leaf) >= 2) SELECT concept, count(*) AS classes, sum(size)::BIGINT AS leaves FROM z GROUP BY concept")
def informative_characters(spark, d):
    t = characters.informative(characters.single_linkage(brands(spark, d)))
    return t.groupBy("concept").agg(F.count("*").alias("classes"), F.sum("size").alias("leaves"))


@query(f"{CG}z AS (SELECT concept, root FROM c GROUP BY 1, 2 HAVING count(DISTINCT leaf) >= 2), o AS (SELECT DISTINCT leaf, concept, root FROM c) SELECT l.leaf, string_agg(CASE WHEN o.leaf IS NULL THEN '0' ELSE '1' END, '' ORDER BY z.concept, z.root) AS bits FROM (SELECT DISTINCT leaf FROM w) l CROSS JOIN z LEFT JOIN o ON o.leaf = l.leaf AND o.concept = z.concept AND o.root = z.root GROUP BY l.leaf")
def binary_matrix(spark, d):
    return characters.binary_matrix(characters.single_linkage(brands(spark, d)))


@query(f"{CG}z AS (SELECT concept, root, count(DISTINCT leaf) AS size FROM c GROUP BY 1, 2 HAVING count(DISTINCT leaf) >= 2), o AS (SELECT leaf, count(*) AS ones FROM (SELECT DISTINCT leaf, concept, root FROM c) JOIN z USING (concept, root) GROUP BY leaf) SELECT leaf, round(coalesce(ones, 0) / (SELECT count(*) FROM z), 6) AS share FROM (SELECT DISTINCT leaf FROM w) LEFT JOIN o USING (leaf)")
def matrix_fill(spark, d):
    return rounded(characters.fill(characters.binary_matrix(characters.single_linkage(brands(spark, d)))))


@query(f"WITH {W}{WP}{WD}SELECT round(avg(shared), 6) AS mean, min(shared) AS least FROM d")
def shared_concepts(spark, d):
    return rounded(distances.shared_summary(distances.word_lists(brands(spark, d))))


@query(f"WITH {W}k AS (SELECT leaf, concept, string_split(form, ' ') AS ts FROM w) SELECT leaf, concept::VARCHAR AS concept, unnest(range(len(ts)))::INT AS position, unnest(ts) AS token, array_to_string(ts, ' ') AS ipa FROM k")
def word_list_rows(spark, d):
    return characters.word_rows(brands(spark, d).withColumn("tokens", F.split("form", " ")))


EXCLUDED = ("the", "he ", " th", "ion", "ent")
SQL_EXCLUDED = ", ".join(f"'{g}'" for g in EXCLUDED)


@query(f"WITH {U}{CH}{gram_sql(3, 'p0')}p AS (SELECT * FROM p0 WHERE gram NOT IN ({SQL_EXCLUDED})), {PAIRS}{JS}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM d")
def ngram_exclusion_js(spark, d):
    listed = spark.createDataFrame([(g,) for g in EXCLUDED], "gram string")
    return rounded(distances.js(profiles.without(grams(spark, d), F.broadcast(listed))))


@query(f"WITH {U}{CH}{gram_sql(3)}x AS (SELECT 1) SELECT leaf, round(sum(CASE WHEN gram IN ({SQL_EXCLUDED}) THEN c ELSE 0 END) / sum(c), 6) AS rate FROM p GROUP BY leaf")
def ngram_hit_rate(spark, d):
    return rounded(profiles.hit_rate(grams(spark, d), list(EXCLUDED)))


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang AS label, round(n / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM n) WHERE r = 1")
def dominant_label(spark, d):
    return rounded(neighbors.dominant(table(spark, d, "documents"), "source", "lang"))


@query("SELECT source, round(avg(CASE WHEN lang = 'en' THEN 100.0 ELSE 0.0 END), 6) AS percent, count(*) AS n, avg(CASE WHEN lang = 'en' THEN 100.0 ELSE 0.0 END) < 70 AS flagged FROM documents GROUP BY source")
def in_target_share(spark, d):
    return rounded(neighbors.in_target(table(spark, d, "documents"), "source", F.col("lang") == "en"))


@query(f"WITH {U.replace(CLEAN, f'translate({CLEAN}, $$aeiou$$, $$$$)')}{CH}{gram_sql(3)}{PAIRS}{JS}x AS (SELECT 1) SELECT i, j, round(d, 6) AS d FROM d")
def devowel_js(spark, d):
    return rounded(distances.js(profiles.profile(units(spark, d).withColumn("text", tx.devowel(F.col("text"))))))


@query(f"WITH {U}x AS (SELECT 1) SELECT leaf, length(string_agg(t, ' ' ORDER BY doc_id)) AS chars, md5(string_agg(t, ' ' ORDER BY doc_id)) AS text FROM u WHERE t <> '' GROUP BY leaf")
def leaf_texts(spark, d):
    t = profiles.joined_units(units(spark, d))
    return t.select("leaf", F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"WITH {U}x AS (SELECT DISTINCT leaf FROM u) SELECT leaf, trim(regexp_replace(leaf, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS safe, replace(leaf, '_', '-') AS dashed, split_part(leaf, '_', 1) AS base FROM x")
def label_functions(spark, d):
    t = leaves(spark, d).select("leaf")
    return t.select("leaf", tx.safe(F.col("leaf")).alias("safe"), tx.dashes(F.col("leaf")).alias("dashed"), tx.base_of(F.col("leaf")).alias("base"))


def brand_texts(spark: SparkSession, d: str) -> DataFrame:
    return brands(spark, d).groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept", "form"))), lambda x: x["form"]), " ").alias("text"))


@query()
def shuffle_control(spark, d):
    t = units(spark, d).withColumn("text", tx.shuffle_chars(0)(F.col("text")))
    return rounded(distances.js(profiles.profile(t)))


@query(f"SELECT doc_id, length({CLEAN.replace('lower(text)', 'nfc_normalize(lower(text))')}) AS n, length({CLEAN.replace('lower(text)', 'strip_accents(lower(text))')}) AS plain FROM documents")
def clean_exact(spark, d):
    t = profiles.spread(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.length(tx.clean()("text")).cast("bigint").alias("n"), F.length(tx.clean(False)("text")).cast("bigint").alias("plain"))


@query()
def ncd_basic(spark, d):
    return rounded(distances.ncd(brand_texts(spark, d), "basic"))


@query()
def ncd_v2(spark, d):
    """Over the leaves' own texts; the cap of 30,000 bytes is the distance's own."""
    return rounded(distances.ncd(profiles.joined_units(units(spark, d), 30_000)))


@query()
def ncd_fixed(spark, d):
    return rounded(distances.ncd(profiles.joined_units(units(spark, d), 30_000), "fixed"))


@query(f"{UD3}x AS (SELECT 1) SELECT step::INT AS step, l::INT AS left_id, r::INT AS right_id, round(h, 6) AS height, size::INT AS size FROM mg")
def upgma(spark, d):
    return rounded(trees.linkage(js9(spark, d))[0])


@query(f"{UD3}x AS (SELECT leaf, max(node) AS node FROM an, nl WHERE step < n - 4 GROUP BY leaf), y AS (SELECT leaf, min(leaf) OVER (PARTITION BY node) AS first FROM x) SELECT leaf, dense_rank() OVER (ORDER BY first)::INT AS cluster FROM y")
def flat_clusters(spark, d):
    return trees.linkage(js9(spark, d))[1]


@query()
def nj(spark, d):
    return trees.build(js9(spark, d), "nj")


@query(f"{UD3}x AS (SELECT a.leaf AS i, b.leaf AS j, min(a.step) AS step FROM an a JOIN an b ON a.node = b.node AND a.leaf < b.leaf GROUP BY ALL) SELECT round(corr(d, h), 6) AS r FROM x JOIN mg USING (step) JOIN d9 USING (i, j)")
def cophenetic(spark, d):
    return rounded(trees.cophenetic_corr(js9(spark, d)))


@query(f"""{UD3}{G}ev AS (SELECT list(leaf ORDER BY leaf) AS every FROM lf), sd AS (SELECT 't' AS k, list(leaf ORDER BY leaf) AS side FROM an GROUP BY node UNION ALL SELECT 'g', list(leaf ORDER BY leaf) FROM g GROUP BY grp),
o AS (SELECT k, side, list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) AS other FROM sd, ev), sp AS (SELECT DISTINCT k, CASE WHEN len(side) < len(other) THEN side WHEN len(side) > len(other) THEN other ELSE least(side, other) END AS split FROM o WHERE len(side) >= 2 AND len(other) >= 2),
z AS (SELECT split, count(*) AS n FROM sp GROUP BY split) SELECT round(count(*) FILTER (n = 1) / sum(n), 6) AS rf FROM z""".replace("o AS (SELECT k,", "oo AS (SELECT k,").replace("FROM o WHERE", "FROM oo WHERE"))
def tree_rf_gold(spark, d):
    tree = trees.build(js9(spark, d))
    return rounded(trees.rf(trees.splits(tree), trees.gold_splits(leaves(spark, d).withColumnRenamed("group", "family"), "family")))


@query(f"WITH {GS} SELECT round(((SELECT count(*) FROM (SELECT split FROM gs WHERE lv = 'family' EXCEPT SELECT split FROM gs WHERE lv = 'initial')) + (SELECT count(*) FROM (SELECT split FROM gs WHERE lv = 'initial' EXCEPT SELECT split FROM gs WHERE lv = 'family'))) / (2 * ((SELECT n FROM n) - 3)), 6) AS rf")
def rf_legacy(spark, d):
    n = nations(spark, d)
    return rounded(trees.rf(trees.gold_splits(n, "family"), trees.gold_splits(n, "initial"), n.count()))


@query(f"WITH {GS} SELECT count(*) AS n FROM (SELECT DISTINCT split FROM gs)")
def internal_bipartitions(spark, d):
    n = nations(spark, d)
    return trees.internal_bipartitions(trees.gold_splits(n, "family").unionByName(trees.gold_splits(n, "initial")))


def genealogy(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with codes below nations below regions, as languoids (id, parent_id, iso)."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("iso"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit(None).cast("string").alias("iso"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("iso"))
    return r.unionByName(n).unionByName(s)


LN = """l AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS iso FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
up(leaf, node, depth) AS (SELECT iso, min(id), 0 FROM l WHERE iso IS NOT NULL GROUP BY iso UNION ALL SELECT up.leaf, l.parent_id, up.depth + 1 FROM up JOIN l ON l.id = up.node WHERE l.parent_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {LN} SELECT leaf, depth, node AS ancestor FROM up")
def lineages(spark, d):
    return readers.lineages(spark, genealogy(spark, d))


@query(f"""WITH RECURSIVE {LN}, e AS (SELECT list(DISTINCT leaf ORDER BY leaf) AS every FROM up), g AS (SELECT list(DISTINCT leaf ORDER BY leaf) AS side FROM up WHERE depth > 0 GROUP BY node),
o AS (SELECT side, list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) AS other FROM g, e)
SELECT DISTINCT array_to_string(CASE WHEN len(side) < len(other) THEN side WHEN len(side) > len(other) THEN other ELSE least(side, other) END, '|') AS split FROM o WHERE len(side) >= 2 AND len(other) >= 2""")
def genealogy_splits(spark, d):
    return trees.lineage_splits(readers.lineages(spark, genealogy(spark, d))).select(F.array_join("split", "|").alias("split"))


@query(f"""WITH {GS}, pm AS (SELECT rep, leaf, row_number() OVER (PARTITION BY rep ORDER BY leaf) AS place, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || leaf), leaf) AS drawn FROM t, (SELECT unnest(range(1, 501)) AS rep)),
po AS (SELECT a.rep, a.leaf, b.leaf AS other FROM pm a JOIN pm b ON a.rep = b.rep AND a.place = b.drawn), sd AS (SELECT rep, split, list(other ORDER BY other) AS side FROM (SELECT split, unnest(split) AS leaf FROM gs WHERE lv = 'initial') JOIN po USING (leaf) GROUP BY rep, split),
oo AS (SELECT rep, side, (SELECT list(leaf ORDER BY leaf) FROM t WHERE NOT list_contains(side, leaf)) AS other FROM sd), sq AS (SELECT DISTINCT rep, CASE WHEN len(side) < len(other) THEN side WHEN len(side) > len(other) THEN other ELSE least(side, other) END AS split FROM oo),
gg AS (SELECT split FROM gs WHERE lv = 'family') SELECT rep, round((count(*) + (SELECT count(*) FROM gg) - 2 * count(gg.split)) / (2 * ((SELECT n FROM n) - 3)), 6) AS rf FROM sq LEFT JOIN gg USING (split) GROUP BY rep""")
def label_shuffle_null(spark, d):
    n = nations(spark, d)
    return rounded(trees.label_shuffle_null(trees.gold_splits(n, "initial"), trees.gold_splits(n, "family"), n.select("leaf")))


@query(f"""{UD3}lx AS (SELECT leaf, 5.0 + 10.0 * (row_number() OVER (ORDER BY arg_max(path, step)) - 1) AS x FROM an GROUP BY leaf), xs(step, x, y) AS (SELECT 0::BIGINT, (SELECT list(lx.x::DOUBLE ORDER BY id) FROM lx JOIN lf USING (leaf)), (SELECT list(0.0::DOUBLE) FROM lf)
UNION ALL SELECT xs.step + 1, list_append(x, (x[l + 1] + x[r + 1]) / 2), list_append(y, h) FROM xs JOIN mg ON mg.step = xs.step) SELECT mg.step::INT AS step, x[l + 1] AS x_left, x[r + 1] AS x_right, round(y[l + 1], 6) AS y_left, round(y[r + 1], 6) AS y_right, round(h, 6) AS y FROM mg, (SELECT x, y FROM xs ORDER BY step DESC LIMIT 1)""")
def dendrogram_layout(spark, d):
    return rounded(trees.layout(trees.linkage(js9(spark, d))[0]))


@query()
def random_tree_null(spark, d):
    n = nations(spark, d).select("leaf", "family").orderBy("leaf").collect()  # 25 nations
    return rounded(trees.random_null(spark, [r["leaf"] for r in n], trees.gold_newick([(r["leaf"], r["family"]) for r in n])))


@query()
def rf_triple(spark, d):
    n = nations(spark, d).orderBy("leaf").collect()  # 25 nations
    gold, other = (trees.gold_newick([(r["leaf"], r[level]) for r in n]) for level in ("family", "initial"))
    return rounded(trees.rf_triple(spark, other, gold, [r["leaf"] for r in n]))


def role_units(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").where("text is not null")
    return t.select(F.concat_ws("_", "role", F.col("turn").cast("string")).alias("leaf"), F.col("conv_id").cast("string").alias("unit_id"), tx.clean_sql(F.col("text")).alias("text"))


def role_groups(spark: SparkSession, d: str) -> DataFrame:
    return role_units(spark, d).select("leaf", F.split("leaf", "_")[0].alias("group")).distinct()


#: Replicates of the bootstraps.
REPS = 50
BOOT = f"""WITH u AS (SELECT conv_id::VARCHAR AS unit_id, role || '_' || turn AS leaf, {CLEAN} AS t FROM conversations WHERE text IS NOT NULL),
ch AS (SELECT unit_id, leaf, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT unit_id, leaf, string_split(t, '') AS cs FROM u WHERE t <> '')),
g AS (SELECT leaf, unit_id, gram, count(*) AS c FROM (SELECT leaf, unit_id, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS gram FROM ch WINDOW w AS (PARTITION BY leaf, unit_id ORDER BY i)) WHERE gram IS NOT NULL GROUP BY ALL),
un AS (SELECT unit_id, row_number() OVER (ORDER BY md5(unit_id), unit_id) - 1 AS k FROM (SELECT DISTINCT unit_id FROM u)),
dr AS (SELECT rep, ('0x' || substr(md5('0:' || rep || ':' || k), 1, 15))::BIGINT % (SELECT count(*) FROM un) AS k FROM un, (SELECT unnest(range({REPS})) AS rep)),
wt AS (SELECT rep, unit_id, count(*) AS w FROM dr JOIN un USING (k) GROUP BY ALL),
p AS (SELECT rep, leaf, gram, sum(c * w) AS c FROM g JOIN wt USING (unit_id) GROUP BY ALL), s AS (SELECT rep, leaf, gram, c / sum(c) OVER (PARTITION BY rep, leaf) AS p FROM p), lv AS (SELECT DISTINCT rep, leaf FROM p),
o AS (SELECT a.rep, a.leaf AS i, b.leaf AS j, sum(0.5 * a.p * log2(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * log2(b.p / ((a.p + b.p) / 2)) - (a.p + b.p) / 2) AS s FROM s a JOIN s b ON a.rep = b.rep AND a.gram = b.gram AND a.leaf < b.leaf GROUP BY ALL),
d AS (SELECT a.rep, a.leaf AS i, b.leaf AS j, sqrt(greatest(0.0, 1.0 + coalesce(s, 0.0))) AS d FROM lv a JOIN lv b ON a.rep = b.rep AND a.leaf < b.leaf LEFT JOIN o ON o.rep = a.rep AND o.i = a.leaf AND o.j = b.leaf), """


@query(f"{BOOT}x AS (SELECT 1) SELECT rep, i, j, round(d, 6) AS d FROM d")
def block_replicates(spark, d):
    return rounded(inference.block_replicates(role_units(spark, d), REPS))


@query(f"{BOOT}sy AS (SELECT rep, i, j, round(d, 9) AS d FROM d UNION ALL SELECT rep, j, i, round(d, 9) FROM d), nn AS (SELECT rep, i, arg_min(j, (d, j)) AS j FROM sy GROUP BY rep, i), pu AS (SELECT rep, avg((split_part(i, '_', 1) = split_part(j, '_', 1))::INT) AS p FROM nn GROUP BY rep), q AS (SELECT quantile_cont(p, [0.025, 0.5, 0.975]) AS q FROM pu) SELECT round(q[1], 6) AS lo, round(q[2], 6) AS med, round(q[3], 6) AS hi FROM q")
def block_bootstrap(spark, d):
    return rounded(inference.purity_interval(inference.block_replicates(role_units(spark, d), REPS), role_groups(spark, d)))


#: Average linkage of all replicates at once: an has each leaf's clusters.
BTREE = """lf AS (SELECT leaf, row_number() OVER (ORDER BY leaf) - 1 AS id FROM (SELECT DISTINCT leaf FROM lv)), nl AS (SELECT count(*) AS n FROM lf),
ut(rep, step, i, j, d, si, sj) AS (SELECT rep, 0::BIGINT, a.id, b.id, d.d, 1::BIGINT, 1::BIGINT FROM d JOIN lf a ON a.leaf = d.i JOIN lf b ON b.leaf = d.j
UNION ALL SELECT * FROM (WITH mn AS (SELECT rep, any_value(step) AS s, arg_min(i, (d, i, j)) AS a, arg_min(j, (d, i, j)) AS b, arg_min(si, (d, i, j)) AS sa, arg_min(sj, (d, i, j)) AS sb FROM ut GROUP BY rep)
SELECT rep, step + 1, i, j, d, si, sj FROM ut JOIN mn USING (rep) WHERE i NOT IN (a, b) AND j NOT IN (a, b)
UNION ALL SELECT rep, s + 1, x, (SELECT n FROM nl) + s, (sa * max(d) FILTER (o = a) + sb * max(d) FILTER (o = b)) / (sa + sb), max(sx), sa + sb
FROM (SELECT rep, CASE WHEN i IN (a, b) THEN j ELSE i END AS x, CASE WHEN i IN (a, b) THEN i ELSE j END AS o, CASE WHEN i IN (a, b) THEN sj ELSE si END AS sx, d, s, a, b, sa, sb FROM ut JOIN mn USING (rep) WHERE (i IN (a, b)) <> (j IN (a, b))) GROUP BY rep, x, s, a, b, sa, sb)),
mg AS (SELECT rep, step, arg_min(i, (d, i, j)) AS l, arg_min(j, (d, i, j)) AS r FROM ut GROUP BY rep, step),
an(rep, leaf, node) AS (SELECT rep, leaf, id FROM lv JOIN lf USING (leaf) UNION ALL SELECT an.rep, an.leaf, nl.n + mg.step FROM an JOIN mg ON mg.rep = an.rep AND an.node IN (mg.l, mg.r), nl),
ev AS (SELECT rep, list(leaf ORDER BY leaf) AS every FROM lv GROUP BY rep UNION ALL SELECT -1, list(leaf ORDER BY leaf) FROM lf), sd AS (SELECT rep, list(leaf ORDER BY leaf) AS side FROM an GROUP BY rep, node UNION ALL SELECT -1, list(leaf ORDER BY leaf) FROM lf GROUP BY split_part(leaf, '_', 1)),
oo AS (SELECT rep, side, list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) AS other FROM sd JOIN ev USING (rep)),
sp AS (SELECT DISTINCT rep, CASE WHEN len(side) < len(other) THEN side WHEN len(side) > len(other) THEN other ELSE least(side, other) END AS split FROM oo WHERE len(side) >= 2 AND len(other) >= 2), """


@query(BOOT.replace("WITH ", "WITH RECURSIVE ", 1) + BTREE + "gg AS (SELECT split FROM sp WHERE rep = -1), rf AS (SELECT rep, (count(*) + (SELECT count(*) FROM gg) - 2 * count(gg.split)) / (count(*) + (SELECT count(*) FROM gg)) AS rf FROM sp LEFT JOIN gg USING (split) WHERE rep >= 0 GROUP BY rep), q AS (SELECT quantile_cont(rf, [0.025, 0.5, 0.975]) AS q FROM rf) SELECT round(q[1], 6) AS lo, round(q[2], 6) AS med, round(q[3], 6) AS hi FROM q")
def block_bootstrap_rf(spark, d):
    gold = trees.gold_splits(role_groups(spark, d).withColumnRenamed("group", "family"), "family")
    return rounded(inference.rf_interval(inference.block_replicates(role_units(spark, d), REPS), gold))


@query(f"{BOOT}x AS (SELECT rep, gram, sum(c)::BIGINT AS c FROM p WHERE leaf = 'user_0' GROUP BY ALL) SELECT * FROM x")
def leaf_bootstrap(spark, d):
    return inference.leaf_replicates(role_units(spark, d), "user_0", REPS)


BOOT_ALL = BOOT.replace("wt AS (SELECT rep, unit_id, count(*) AS w FROM dr JOIN un USING (k) GROUP BY ALL)", f"wt AS (SELECT rep, unit_id, count(*) AS w FROM dr JOIN un USING (k) GROUP BY ALL UNION ALL SELECT {REPS}, unit_id, 1 FROM un)")


@query(BOOT_ALL.replace("WITH ", "WITH RECURSIVE ", 1) + BTREE + f"rs AS (SELECT split FROM sp WHERE rep = {REPS}), z AS (SELECT split, count(*) AS n FROM sp WHERE rep BETWEEN 0 AND {REPS - 1} GROUP BY split) SELECT array_to_string(split, '|') AS split, round(coalesce(n, 0) / {REPS}, 6) AS support FROM rs LEFT JOIN z USING (split)")
def branch_support(spark, d):
    t = role_units(spark, d)
    found = inference.support(distances.js(profiles.profile(t)), inference.block_replicates(t, REPS), REPS)
    return found.select(F.array_join("split", "|").alias("split"), F.round("support", 6).alias("support"))


@query()
def branch_support_nj(spark, d):
    t = role_units(spark, d)
    return inference.support(distances.js(profiles.profile(t)), inference.block_replicates(t, REPS), REPS, "nj")


@query()
def token_bootstrap(spark, d):
    p = profiles.profile(role_units(spark, d))
    return inference.support(distances.js(p), inference.token_replicates(p, REPS), REPS)


@query()
def token_bootstrap_ci(spark, d):
    """Purity and Robinson-Foulds intervals of one set of token replicates."""
    groups = role_groups(spark, d)
    reps = inference.token_replicates(profiles.profile(role_units(spark, d)), REPS)
    gold = trees.gold_splits(groups.withColumnRenamed("group", "family"), "family")
    return rounded(inference.purity_interval(reps, groups).withColumn("of", F.lit("purity")).unionByName(inference.rf_interval(reps, gold).withColumn("of", F.lit("rf"))))


@query(f"WITH {W}{WP}{WD}, lf AS (SELECT DISTINCT leaf, left(leaf, 7) AS clade FROM w), q AS (SELECT a.clade, a.leaf AS a, b.leaf AS b, c.leaf AS c, e.leaf AS e FROM lf a JOIN lf b ON a.clade = b.clade AND a.leaf < b.leaf JOIN lf c ON b.clade = c.clade AND b.leaf < c.leaf JOIN lf e ON c.clade = e.clade AND c.leaf < e.leaf), s AS (SELECT q.clade, {DL.partition('list_sort')[1]}{DL.partition('list_sort')[2].partition(')' + chr(10) + 'SELECT round(avg')[0]}) SELECT clade, round(avg(CASE WHEN s[3] - s[1] <= 1e-12 THEN 0.0 ELSE (s[3] - s[2]) / (s[3] - s[1]) END), 6) AS delta, count(*) AS n FROM s GROUP BY clade")
def delta_by_clade(spark, d):
    w = brands(spark, d)
    clades = w.select(F.left("leaf", F.lit(7)).alias("clade"), "leaf").distinct()
    return rounded(quartets.clade_delta(distances.word_lists(w), clades))


@query("SELECT doc_id, lang || repeat('_', (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INT) AS label FROM (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, source)")
def unique_labels(spark, d):
    t = table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    return readers.unique_labels(t.select("doc_id", F.col("lang").alias("label")), "label", "doc_id").select("doc_id", "label")


@query("WITH m AS (SELECT p_partkey, 'f' || lpad(p_partkey::VARCHAR, 9, '0') || CASE p_partkey % 5 WHEN 0 THEN '_PART' WHEN 1 THEN '_Tokenized' ELSE '' END AS f, p_brand AS l, CASE WHEN p_size > 25 THEN 'True' END AS full_ FROM part) SELECT l AS \"Language\", arg_min(f, (full_ IS DISTINCT FROM 'True', f)) AS \"Filename\" FROM m WHERE NOT regexp_matches(f, '(?i)PART|tokenized') GROUP BY l")
def row_selection(spark, d):
    t = table(spark, d, "part")
    name = F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(F.col("p_partkey") % 5 == 0, "_PART").when(F.col("p_partkey") % 5 == 1, "_Tokenized").otherwise(""))
    return readers.selected(t.select(name.alias("Filename"), F.col("p_brand").alias("Language"), F.when(F.col("p_size") > 25, "True").alias("Full"))).select("Language", "Filename")


@query("SELECT c_custkey::VARCHAR AS \"Filename\", c_name AS leaf FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def present_files(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("Filename"), F.col("c_name").alias("leaf"))
    return readers.present(meta, table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_rows(spark, d):
    meta = table(spark, d, "customer").select("c_custkey")
    return readers.missing(meta, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


ALIASES = (("NATION_0", "NATION_1"), ("NATION_2", "NATION_3"))


@query("WITH a(iso, other) AS (VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in ALIASES) + "), m AS (SELECT 'leaf_' || n_nationkey AS leaf, n_name AS iso FROM nation) SELECT leaf, m.iso, s_name AS doculect FROM m LEFT JOIN a USING (iso) JOIN nation n ON n.n_name = coalesce(other, m.iso) JOIN supplier ON s_nationkey = n.n_nationkey")
def iso_join(spark, d):
    n = table(spark, d, "nation")
    languages = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("ID"), F.col("n_name").alias("ISO639P3code"))
    return readers.iso_join(n.select(F.concat(F.lit("leaf_"), "n_nationkey").alias("leaf"), F.col("n_name").alias("iso")), languages, spark.createDataFrame(ALIASES, "iso string, other string"))


@query("WITH f AS (SELECT DISTINCT lang || '_' || source AS stem FROM documents WHERE lang <> 'es'), w AS (SELECT DISTINCT lang AS iso, source AS script FROM documents), a(iso, other) AS (VALUES ('en', 'fr'), ('en', 'de'), ('de', 'fr')), o AS (SELECT 'es' AS iso, source AS script, 'en_' || source AS stem, 1 AS ord FROM (SELECT DISTINCT source FROM documents)), c AS (SELECT iso, script, 0 AS kind, '' AS place, iso || '_' || script AS stem FROM w UNION ALL SELECT iso, script, 1, other, other || '_' || script FROM w JOIN a USING (iso) UNION ALL SELECT iso, script, 2, ord::VARCHAR, stem FROM w JOIN o USING (iso, script)), b AS (SELECT iso, script, arg_min(stem, (kind, place, stem)) AS stem FROM c SEMI JOIN f USING (stem) GROUP BY iso, script) SELECT iso, script, stem FROM w LEFT JOIN b USING (iso, script)")
def line_files(spark, d):
    t = table(spark, d, "documents")
    wanted = t.select(F.col("lang").alias("iso"), F.col("source").alias("script")).distinct()
    files = t.where("lang <> 'es'").select(F.concat_ws("_", "lang", "source").alias("stem"))
    over = t.select("source").distinct().select(F.lit("es").alias("iso"), F.col("source").alias("script"), F.concat(F.lit("en_"), "source").alias("stem"), F.lit(1).alias("ord"))
    return readers.line_files(wanted, files, spark.createDataFrame([("en", "fr"), ("en", "de"), ("de", "fr")], "iso string, other string"), over)


@query("WITH u AS (SELECT role AS leaf, text, row_number() OVER (PARTITION BY role ORDER BY lpad(conv_id::VARCHAR, 12, '0') || ':' || lpad(turn::VARCHAR, 6, '0')) AS r FROM conversations WHERE trim(text) <> '') SELECT leaf, md5(text) AS line FROM u WHERE r <= 300")
def usable_lines(spark, d):
    t = table(spark, d, "conversations")
    place = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    return readers.usable_lines(t.select(F.col("role").alias("leaf"), place.alias("unit_id"), "text")).select("leaf", F.md5(F.col("text").cast("binary")).alias("line"))


@query(r"WITH s AS (SELECT doc_id::VARCHAR AS leaf, regexp_split_to_array(text, '[\n.!?。।]+') AS ps FROM documents WHERE text IS NOT NULL), x AS (SELECT leaf, unnest(range(len(ps))) AS i, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS part FROM s), r AS (SELECT leaf, part, row_number() OVER (PARTITION BY leaf ORDER BY i) AS r FROM x WHERE length(part) > 8) SELECT leaf, md5(part) AS line FROM r WHERE r <= 300")
def text_parts(spark, d):
    """Documents without units fall back to the parts of their texts."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("leaf"), "text")
    none = t.limit(0).withColumn("unit_id", F.lit(0))
    return readers.usable_lines(none, t).select("leaf", F.md5(F.col("text").cast("binary")).alias("line"))


@query("SELECT source, arg_min(lang, (CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang)) AS lang FROM documents GROUP BY source")
def preferred_script(spark, d):
    return neighbors.preferred(table(spark, d, "documents").select("source", "lang").distinct(), "source", "lang", ["fr", "de"])


@query(SQL["mantel_r"].partition("x AS (SELECT 1) SELECT")[0] + "x AS (SELECT 1) SELECT i, j, abs(d.d - d1.d) <= 0.12 AS near FROM d JOIN d1 USING (i, j)")
def within_tolerance(spark, d):
    a, b = distances.js(grams(spark, d)), distances.js(grams(spark, d, 1)).withColumnRenamed("d", "e")
    return a.join(b, ["i", "j"]).select("i", "j", tx.within(F.col("d"), F.col("e")).alias("near"))


@query("WITH f AS (SELECT unnest(['Altaic', 'Altaic(?)', 'Uralic (?)', '', ' ', 'Indo-European']) AS family UNION ALL SELECT r_name || '(?)' FROM region) SELECT family, CASE family WHEN 'Altaic' THEN 'Turkic' WHEN 'Altaic(?)' THEN 'Koreanic' ELSE coalesce(nullif(trim(replace(family, '(?)', '')), ''), 'NA') END AS fixed FROM f")
def family_names(spark, d):
    names = spark.createDataFrame([(x,) for x in ("Altaic", "Altaic(?)", "Uralic (?)", "", " ", "Indo-European")], "family string")
    t = names.unionByName(table(spark, d, "region").select(F.concat("r_name", F.lit("(?)")).alias("family")))
    return t.select("family", tx.fixed_family(F.col("family")).alias("fixed"))


@query("WITH t AS (SELECT role, conv_id::VARCHAR AS unit_id, arg_min(text, turn) AS text FROM conversations GROUP BY ALL), common AS (SELECT unit_id FROM t GROUP BY unit_id HAVING count(*) = (SELECT count(DISTINCT role) FROM t) ORDER BY unit_id LIMIT 4000) SELECT role AS leaf, unit_id, md5(text) AS text FROM t WHERE unit_id IN (SELECT unit_id FROM common)")
def aligned_corpus(spark, d):
    """Roles as files, conversations as units by each role's first text: those that all roles have, the first 4,000."""
    t = table(spark, d, "conversations").groupBy(F.col("role").alias("file"), F.col("conv_id").cast("string").alias("unit_id")).agg(F.min_by("text", "turn").alias("text"))
    meta = t.select(F.col("file").alias("Filename"), F.col("file").alias("leaf")).distinct()
    return readers.corpus(meta, t).select("leaf", "unit_id", F.md5(F.col("text").cast("binary")).alias("text"))
