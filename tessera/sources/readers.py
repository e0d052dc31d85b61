"""Readers: each returns a DataFrame of the engine's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fixed_family


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The keyed CSV of texts with its family names cleaned; genus falls back to family."""
    t = spark.read.csv(path, header=True)
    if "Family" in t.columns:
        t = t.withColumn("Family", fixed_family(F.col("Family")))
        if "Genus" in t.columns:
            t = t.withColumn("Genus", F.coalesce(F.nullif("Genus", F.lit("")), "Family"))
    return t


def verses(spark: SparkSession, path: str) -> DataFrame:
    """file, unit_id, text of <seg type="verse" id="..."> elements with their full inner text; the last of equal ids wins, those without id go."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches):
        import io
        import xml.etree.ElementTree as ET

        for g in batches:
            for name, data in zip(g["file"], g["content"], strict=True):
                found = {}
                for _, e in ET.iterparse(io.BytesIO(data)):
                    if e.tag.rsplit("}", 1)[-1] == "seg" and e.get("type") == "verse":
                        if e.get("id"):
                            found[e.get("id")] = " ".join("".join(e.itertext()).split())
                        e.clear()
                yield pd.DataFrame({"file": name, "unit_id": list(found), "text": list(found.values())}, dtype="object")

    return files.mapInPandas(parse, "file string, unit_id string, text string")


def present(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows whose Filename is among the files."""
    return meta.join(files.select(F.col("file").alias("Filename")).distinct(), "Filename", "left_semi")


def corpus(meta: DataFrame, units: DataFrame, cap: int | None = 4000, align: bool = True, char_cap: int | None = None, return_units: bool = True) -> DataFrame:
    """leaf, unit_id, text: units of the files in meta (Filename, leaf); aligned, only units that all leaves have, the first cap of them.

    char_cap: the leaf's text, its units joined by a space, is cut there. Without return_units: leaf, text, a leaf's whole text as one row.
    """
    from ..operators.neighbors import common_units, first_units
    from ..operators.profiles import capped_units, joined_units

    t = units.join(meta.select(F.col("Filename").alias("file"), "leaf"), "file").select("leaf", "unit_id", "text")
    if align:
        ids = common_units(t)
        t = t.join(ids if cap is None else ids.limit(cap), "unit_id", "left_semi").select("leaf", "unit_id", "text")
    elif cap is not None:
        t = first_units(t, cap)
    if not return_units:
        return joined_units(t, char_cap)
    return t if char_cap is None else capped_units(t, char_cap)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole text files, one row each, such as a built-in corpus with one text a file id."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def through_cache(cached_texts: DataFrame, wanted: DataFrame, work) -> tuple[DataFrame, DataFrame]:
    """(all, new): wanted (leaf, text) as the cache (leaf, text) has them, and the rest by work(DataFrame) -> (leaf, text), which also comes alone,
    to be added to the cache."""
    hit = cached_texts.join(wanted.select("leaf").distinct(), "leaf", "left_semi")
    new = work(missing(wanted, cached_texts, "leaf")).select("leaf", "text")
    return hit.select("leaf", "text").unionByName(new), new


def unique_labels(rows: DataFrame, label: str = "label", order: str = "ord") -> DataFrame:
    """Equal labels get a _ for each one before them."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    return rows.withColumn(label, F.concat(F.col(label), F.repeat(F.lit("_"), n)))


def selected(meta: DataFrame) -> DataFrame:
    """One text of each language, a full one if there is one; parts and tokenised files are out."""
    ok = meta.where(~F.col("Filename").rlike("(?i)PART|tokenized"))
    r = F.row_number().over(Window.partitionBy("Language").orderBy(F.coalesce(F.col("Full"), F.lit("")) != "True", "Filename"))
    return ok.withColumn("r", r).where("r = 1").drop("r")


def word_list(spark: SparkSession, folder: str, candidates: DataFrame | None = None) -> DataFrame:
    """leaf, concept, form, tokens of a CLDF folder's forms.csv; the first form of a concept counts. candidates limits leaves in the scan."""
    t = spark.read.csv(f"{folder}/forms.csv", header=True, quote='"', escape='"')
    t = t.withColumn("line", F.monotonically_increasing_id())
    if candidates is not None:
        t = t.join(candidates.select(F.col(candidates.columns[0]).alias("Language_ID")), "Language_ID", "left_semi")
    tokens = F.filter(F.split(F.coalesce(F.col("Segments"), F.lit("")), r"\s+"), lambda x: x != "") if "Segments" in t.columns else F.array().cast("array<string>")
    t = t.select(F.col("Language_ID").alias("leaf"), F.col("Parameter_ID").alias("concept"), F.col("Form").alias("form"), tokens.alias("tokens"), "line")
    return first_synonyms(t, "line")


def first_synonyms(words: DataFrame, order: str) -> DataFrame:
    """The first row by order of each leaf and concept."""
    rest = [c for c in words.columns if c not in ("leaf", "concept", order)]
    return words.groupBy("leaf", "concept").agg(F.min_by(F.struct(*rest), order).alias("x")).select("leaf", "concept", *[f"x.{c}" for c in rest])


def lines(spark: SparkSession, stem: str, cap: int | None = None) -> DataFrame:
    """unit_id (part:line, in order), text of the files stem.dev and stem.devtest, the first cap lines of each."""
    out = None
    for part in ("dev", "devtest"):
        t = spark.read.text(f"{stem}.{part}", wholetext=True)  # a file's lines stay in its order; such files are small
        t = t.select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("n", "text"))
        t = (t if cap is None else t.where(F.col("n") < cap)).select(F.format_string(f"{part}:%012d", "n").alias("unit_id"), "text")
        out = t if out is None else out.unionByName(t)
    return out


#: Where a text without units is cut, and the fewest characters but one of a usable part.
SENTENCE_ENDS, LEAST_PART = r"[\n.!?。।]+", 8


def usable_lines(units: DataFrame, texts: DataFrame | None = None, most: int = 300) -> DataFrame:
    """leaf, text: the first `most` units (leaf, unit_id, text) of each leaf that aren't blank; of leaves without any, the first parts of
    texts (leaf, text), cut at line and sentence ends, of more than 8 characters."""
    from ..operators.neighbors import first_units

    own = first_units(units.where(F.trim("text") != ""), most).select("leaf", "text")
    if texts is None:
        return own
    parts = missing(texts, own, "leaf").select("leaf", F.posexplode(F.split("text", SENTENCE_ENDS)).alias("unit_id", "text"))
    trimmed = parts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") > LEAST_PART)
    return own.unionByName(first_units(trimmed, most).select("leaf", "text"))


def line_files(wanted: DataFrame, files: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """iso, script, stem: for each wanted (iso, script) the line corpus's file among files (stem): iso_script if it is there, else the first
    other_script of the aliases (iso, other), else the first of the overrides (iso, script, stem, ord); null if there is none."""
    key = ["iso", "script"]
    direct = wanted.select(*key, F.lit(0).alias("kind"), F.lit("").alias("by"), F.concat_ws("_", *key).alias("stem"))
    alias = wanted.join(aliases, "iso").select(*key, F.lit(1).alias("kind"), F.col("other").alias("by"), F.concat_ws("_", "other", "script").alias("stem"))
    other = wanted.join(overrides, key).select(*key, F.lit(2).alias("kind"), F.format_string("%09d", "ord").alias("by"), "stem")
    there = direct.unionByName(alias).unionByName(other).join(files.select("stem").distinct(), "stem", "left_semi")
    best = there.groupBy(*key).agg(F.min(F.struct("kind", "by", "stem")).alias("b"))
    return wanted.select(*key).distinct().join(best, key, "left").select(*key, F.col("b.stem").alias("stem"))


def iso_join(meta: DataFrame, languages: DataFrame, aliases: DataFrame) -> DataFrame:
    """meta (leaf, iso) with the doculects of its code, or of the code's alias (iso, other)."""
    t = meta.join(aliases, "iso", "left").withColumn("code", F.coalesce("other", "iso"))
    return t.join(languages.select(F.col("ID").alias("doculect"), F.col("ISO639P3code").alias("code")), "code").select("leaf", "iso", "doculect")


def missing(meta: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return meta.join(found.select(key).distinct(), key, "left_anti")


def nexus_newick(text: str) -> str:
    """The first tree of a NEXUS file as Newick, with translated labels and without comments."""
    import re

    text = re.sub(r"\[[^\]]*\]", "", text)
    table = {}
    if block := re.search(r"translate(.*?);", text, re.I | re.S):
        table = {k: v.strip().strip("'") for k, v in (x.strip().split(None, 1) for x in block[1].split(",") if x.strip())}
    tree = re.search(r"^\s*tree\s[^=]*=\s*(.*?;)", text, re.I | re.M | re.S)
    if not tree:
        raise ValueError("no tree in the NEXUS file")
    return re.sub(r"(?<=[(,])\s*([^(),:;]+)", lambda m: table.get(m[1].strip(), m[1].strip()), tree[1].strip())


def lineages(spark: SparkSession, languoids: DataFrame) -> DataFrame:
    """leaf, depth, ancestor of languoids (id, parent_id, iso): all ancestors of the first languoid with each code, by a recursive query."""
    languoids.createOrReplaceTempView("tessera_languoids")
    return spark.sql("""
        WITH RECURSIVE up(leaf, node, depth) AS (
          SELECT iso, min(id), 0 FROM tessera_languoids WHERE iso IS NOT NULL AND iso <> '' GROUP BY iso
          UNION ALL SELECT u.leaf, l.parent_id, u.depth + 1 FROM up u JOIN tessera_languoids l ON l.id = u.node WHERE l.parent_id IS NOT NULL
        ) SELECT leaf, depth, node AS ancestor FROM up""")


def cached(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """leaf, text of a cache by tag."""
    return spark.read.parquet(path).where(F.col("tag") == tag).drop("tag")
