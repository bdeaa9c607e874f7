"""Literal words in texts, for many queries in one job: by the texts that have a piece of three letters of the word, the
rarest one that it has, of which the word itself is then looked for. No query goes through all texts.

An index is a table (gram, id), a row for each distinct piece of a text; a store keeps it in buckets by gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Letters of a piece. Words are of as many at least.
LETTERS = 3


def grams(text: Column) -> Column:
    """The distinct pieces of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (LETTERS - 1))
    return F.when(F.length(text) >= LETTERS, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(LETTERS))))).otherwise(F.array().cast("array<string>"))


def texts_of(vertices: DataFrame, paths: bool = False) -> DataFrame:
    """(id, text) of vertices: what their contexts, and their paths, say, in lower case."""
    said = [F.array_join("contexts", " ")] + (["path"] if paths else [])
    return vertices.select("id", F.lower(F.concat_ws(" ", *said)).alias("text"))


def index(texts: DataFrame) -> DataFrame:
    """(gram, id) of texts (id, text). A null text has no pieces."""
    return texts.select(F.explode(grams(F.col("text"))).alias("gram"), "id")


def frequencies(postings: DataFrame) -> DataFrame:
    """(gram, texts): in how many texts each piece is."""
    return postings.groupBy("gram").agg(F.count("*").alias("texts"))


def found(postings: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, id): the texts (id, text) that have each distinct word of words (word), of LETTERS letters at least. What
    an index has beyond the texts, or a text beyond its index, isn't found."""
    asked = kept(words.select("word").distinct().filter(F.length("word") >= LETTERS).select("word", F.explode(grams(F.col("word"))).alias("gram")))
    # Only pieces that words have are counted. One that no text has is the rarest: its word is nowhere.
    rare = frequencies(postings.join(asked.select("gram").distinct(), "gram", "left_semi"))
    least = asked.join(rare, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "gram")).alias("m"))
    likely = least.filter("m.n > 0").select("word", "m.gram").join(postings, "gram").select("word", "id")
    return likely.join(texts, "id").filter(F.contains("text", F.col("word"))).select("word", "id")


def matches_each(vertices: DataFrame, queries: DataFrame, top: int = 10, paths: bool = False, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, id): what recall.context_matches() finds for each of queries (query_id, text): of each word the `top`
    vertices by myelination that have it in a context (or path); tools are no results. postings: the index, if there
    is one already."""
    texts = texts_of(vertices, paths)
    words = kept(queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= LETTERS))).alias("word")))
    hits = found(index(texts) if postings is None else postings, texts, words).join(vertices.select("id", "type", "myelination"), "id")
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("myelination"), "id"))).filter(F.col("k") <= top)
    return words.join(best.filter("type <> 'tool'"), "word").select("query_id", "id").distinct()
