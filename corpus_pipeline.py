"""A corpus pipeline: language, quality, boilerplate lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and is written as Parquet before the next one reads it. All but the last return
the columns of ``documents``, extra ones too, whatever their names.

Edge cases, for every stage: no documents give no rows; very long texts are taken
whole. What each stage does with null or empty texts, null ids, ties and repeated
rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import langid, linededup, neardup, packing, quality
from locusloom.llm.common import discarded, table, written

#: Documents whose language is less sure than this are rejected, and those whose quality scores below that. A winner of
#: two families of two languages is never less sure than 0.25, so with such labels only texts without a letter are
#: rejected; the bound tells among more families and languages.
LEAST_LANGUAGE, LEAST_QUALITY = 0.2, 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those of no sure language.

    Repeated rows have the same fate; a tie of votes goes to the greater sum of chances, then to the first name.
    """
    found = langid.predict(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE)).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the least quality; null counts as an empty text, repeated rows have the same fate, a score at the bound stays."""
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.where(F.col("quality_score") >= LEAST_QUALITY).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; a document goes if nothing else is in it. n_chars follows the text.

    Null and empty texts stay; a line stays in the row of the least doc_id that has it (null first), and in all its repeats.
    """
    found = linededup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = found.where((F.col("n_removed") == 0) | (F.btrim(F.col("text"), F.lit(linededup.BLANKS + "\n")) != ""))
    return kept.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the least doc_id.

    Texts without words, null ones too, are one class. A null doc_id stays only if no document with an id has an equal
    text. Of repeated rows one stays.
    """
    return neardup.dedup(docs).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids, sequence_id, offset. A null text counts as empty; repeated rows are packed each on their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Fitted models, signatures and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discarded(before)
    return STAGES[-1][1](spark, docs, sf_dir)
