"""The subpackage's queries over the input tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontaminate, language_id, line_dedup, media, near_duplicates, quality, substring_dedup, suffix_tree, toxicity
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_media that SQL can say."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum.mixture(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_quality, op4_suffix_tree, op5_language_id, op6_jaccard_join, op7_media, op8_curriculum, op9_line_dedup, op10_decontamination, media_payloads)}


OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (h) WHERE doc_id > least),
gone AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
x AS (SELECT w.doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w WHERE len(ws) > 0),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.i = r.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= 0.8 * (na.n + nb.n - k) - 1e-9),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM c WHERE c.a = d.doc_id)) AS class_id,
  least(d.doc_id, (SELECT min(b) FROM l WHERE same AND l.a = d.doc_id)) AS copy_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""

PAYLOADS = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) * 64 AS m FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || unhex(repeat('00', (m - n)::INT))) AS payload_sha256, m + 44 AS media_bytes FROM n
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT source, source_size, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE -0.5 END::DOUBLE AS ramp FROM r),
f AS (SELECT *, 2.0 * source_size::DOUBLE AS lim, 2.0 * source_size::DOUBLE / w AS cap FROM w),
v AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
u AS (SELECT level AS l FROM v WHERE level <= cap ORDER BY cap, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, ramp, least(lim, coalesce((SELECT l FROM u) * w, lim)) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size = 0 OR source_size = 0 THEN 0 ELSE floor(target / source_size) + CASE WHEN middle < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END::BIGINT AS copies, least(1.0, greatest(0.0, middle / target)) AS x FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * copies)::BIGINT AS taken,
  round(CASE WHEN copies = 0 THEN NULL WHEN ramp = 0 THEN x ELSE (ramp - 1.0 + sqrt((1.0 - ramp) * (1.0 - ramp) + 4.0 * ramp * x)) / (2.0 * ramp) END, 6) AS first_position
FROM c
"""

OP9 = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (SELECT k, min((doc_id, pos)) AS first FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
x AS (SELECT t.*, first IS NOT NULL AND (doc_id, pos) <> first AS gone FROM t LEFT JOIN b USING (k)),
a AS (SELECT doc_id, count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a USING (doc_id)
"""

OP10 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item_id, least(10, len(ws)) AS m, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0),
b AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM bp),
ms AS (SELECT DISTINCT m FROM b),
dp AS (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, ms WHERE len(ws) >= m),
h AS (SELECT doc_id, i, b.m, item_id FROM (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM dp) p JOIN b ON p.m = b.m AND p.g = b.g),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op6_jaccard_join": OP6, "media_payloads": PAYLOADS, "op8_curriculum": OP8, "op9_line_dedup": OP9, "op10_decontamination": OP10}
