"""The corpus pipeline: raw documents to a mixture for training, in five stages.

All stages take tables (doc_id, text, lang, source, ...) of any size, the empty one too (it gives an empty table), texts
of any length, repeated rows, and columns of any name beside these, which pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import decontaminate, language, lines, mixing, nearcopies
from trailweave.llm.common import fresh, keep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't clear among those that are learned, go; null texts too.

    Repeated rows stay or go together. A text in a language that wasn't learned is taken for the nearest one."""
    return language.recognised(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut. A document of which nothing is left repeats others as a whole and goes.

    Null texts stay; rows that repeat number and text are one text and stay together."""
    mark = fresh(docs.columns, "_own_count")
    given = docs.withColumnRenamed("_deleted_lines", mark) if "_deleted_lines" in docs.columns else docs
    out = lines.dedup_lines(given)
    out = out.filter("_deleted_lines = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").drop("_deleted_lines")
    return out.withColumnRenamed(mark, "_deleted_lines").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document of the smallest number
    stays. Rows that repeat number and text stay once; rows without a number are only known by their text; null texts and
    texts without words are copies of one another."""
    copies = nearcopies.near_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    mark = fresh(docs.columns, "_copy")
    marks = keep(copies.withColumn(mark, F.lit(True)).unionByName(twice.join(copies, "doc_id", "left_anti").withColumn(mark, F.lit(False))))
    marked = docs.join(marks.hint("merge"), "doc_id", "left").select(*docs.columns, mark)
    once = marked.filter(F.col(mark).isNull() & F.col("doc_id").isNotNull())
    again = marked.filter(~F.coalesce(mark, F.col("doc_id").isNotNull())).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).drop(mark)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of the benchmark go; single windows of it are cut from the others. Null texts stay, and
    repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document once at least, small sources more often. Null texts cost nothing; repeated rows are
    in or out together."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs


#: Language identification by a trained model isn't expressible in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
