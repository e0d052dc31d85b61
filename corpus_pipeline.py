"""The corpus pipeline: five stages, each over all that the stage before it kept.

Counted as part of the subpackage of training-data operators, and removed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum, decontaminate, language_id, line_dedup, near_duplicates
from tessera.llm.common import table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go. A text of one language is never rejected for
    another reason; lang takes the predicted language where it is null. If no text has a lang, there is no language to
    learn: texts with a letter stay, and their lang is und."""
    model = language_id.fit(docs)
    found = language_id.identified(docs, model).where("__lang_pred <> 'und'" if model[0] else language_id.has_letter("text"))
    return found.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; documents of which no line stays go, and n_chars follows the text."""
    out = line_dedup.line_dedup(docs).where("__n_removed = 0 or __n_lines > __n_removed")
    return out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_duplicates.representatives(docs).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents in training order, with copy and position."""
    return curriculum.mixed_documents(docs)


STAGES = [("language ID", identify), ("line dedup", cut_lines), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", uncontaminated), ("mixing sources", mix)]

#: Language ID's fitted probabilities and the forest's signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet to the shared folder and read again."""
    from tessera.llm.common import stored

    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
