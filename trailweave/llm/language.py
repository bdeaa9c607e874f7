"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts are summed in the tasks, one row a (language, bucket) and task, then by a grouped sum. What is
broadcast is the matrix of log-probabilities: `buckets` rows, a column a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces

#: Characters that are held as n-grams at once.
CHARACTERS_AT_ONCE = 1 << 16
UNKNOWN = "und"


class Grams:
    """Hashed n-grams of 1 to `orders` characters: lower case, each run of other characters than letters a space."""

    def __init__(self, orders: int, buckets: int) -> None:
        self.orders, self.buckets = orders, buckets
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _pieces(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        """The characters of a text, CHARACTERS_AT_ONCE at a time, and how many of a piece are the last of the piece
        before: `orders` - 1, so that no n-gram is cut, and none counted twice."""
        text = f" {text.lower()} "
        held = np.array([], np.uint32)
        for start in range(0, len(text), CHARACTERS_AT_ONCE):
            codes = np.frombuffer(text[start : start + CHARACTERS_AT_ONCE].encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(self.letter[codes], codes, np.uint32(32))
            before = held[-1] if len(held) else 0
            codes = codes[(codes != 32) | (np.append(before, codes[:-1]) != 32)]
            held = np.append(held[max(0, len(held) - self.orders + 1) :], codes).astype(np.uint32)
            yield held, len(held) - len(codes)

    def batches(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text numbers, ascending; buckets), in pieces. Long texts come in several."""
        held, owners, known, size = [], [], [], 0
        for i, text in enumerate(texts):
            for characters, before in self._pieces(text) if text else ():
                held.append(characters)
                owners.append(i)
                known.append(before)
                size += len(characters)
                if size >= CHARACTERS_AT_ONCE:
                    yield self._hashed(held, owners, known)
                    held, owners, known, size = [], [], [], 0
        if held:
            yield self._hashed(held, owners, known)

    def _hashed(self, held: list[np.ndarray], owners: list[int], known: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = np.concatenate(held), np.array([*map(len, held)])
        piece = np.repeat(np.arange(len(held)), lengths)
        starts = np.cumsum(lengths) - lengths
        new = np.arange(len(flat)) >= np.repeat(starts + known, lengths)
        numbers, hashed = [], []
        code = np.zeros(len(flat), np.uint32)
        for n in range(self.orders):
            size = len(flat) - n
            if size <= 0:
                break
            code = code[:size] * np.uint32(0x01000193) + flat[n:] + np.uint32(n + 1)
            whole = (piece[:size] == piece[n:]) & new[n:]
            if n == 0:
                whole &= flat != 32
            mixed = code ^ (code >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            hashed.append(((mixed >> np.uint32(8)) % np.uint32(self.buckets))[whole])
            numbers.append(piece[:size][whole])
        number, bucket = np.concatenate(numbers), np.concatenate(hashed)
        order = np.argsort(number, kind="stable")
        return np.asarray(owners)[number[order]], bucket[order]


@dataclass(frozen=True)
class Model:
    """languages in order; weights: a row of log-probabilities a bucket; prior: log-shares of the documents."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: int

    def predict(self, texts: list[str | None], grams: Grams) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the probability; und and 0 without a letter.

        N-grams of several orders overlap, so their evidence is divided by the number of orders."""
        total = np.tile(self.prior * self.orders, (len(texts), 1)).astype(float)
        for owner, bucket in grams.batches(texts):
            if len(owner):
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                total[owner[starts]] += np.add.reduceat(self.weights[bucket], starts, axis=0)
        total /= self.orders
        known = [bool(self.languages) and any(map(str.isalpha, t or "")) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(share, known, strict=True)]


def held_out(doc_id: Column) -> Column:
    """The rule that no training looks at: crc32 of the number as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, orders: int = 3, buckets: int = 1 << 15, max_languages: int = 256) -> Model:
    """Learns from the rows of labelled (text, lang) with a language and a text.

    The `max_languages` languages with the most such rows are learned (of as many rows, the first by name); rows of
    rarer ones are left out. That bounds the matrix that is gathered and broadcast, at 32 MB by default, and is no
    error: a column with thousands of wrong values still gives a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums, documents = Grams(orders, buckets), {}, {}
        for batch in pieces(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                counts = sums.setdefault(lang, np.zeros(buckets, np.int64))
                documents[lang] = documents.get(lang, 0) + len(own)
                for _, bucket in grams.batches(own):
                    counts += np.bincount(bucket, minlength=buckets)
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(some) + 1), "bucket": pa.array([-1, *some.tolist()], pa.int32()), "n": pa.array([documents[lang], *counts[some].tolist()], pa.int64())})

    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    languages = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()]
    languages.sort()
    counted = rows.filter(F.col("lang").isin(languages)).mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    numbers = F.map_from_arrays(F.array(*map(F.lit, languages)), F.sequence(F.lit(0), F.lit(len(languages) - 1))) if languages else F.lit(None)
    flat = counted.select(numbers[F.col("lang")].alias("k") if languages else F.lit(0).alias("k"), "bucket", "n").toArrow()
    k, bucket, n = (flat.column(c).to_numpy() for c in ("k", "bucket", "n"))
    weights, prior = np.full((buckets, len(languages)), 0.5), np.zeros(len(languages))
    documents = bucket < 0
    prior[k[documents]] = n[documents]
    weights[bucket[~documents], k[~documents]] += n[~documents]
    if languages:
        prior = np.log(prior / prior.sum())
        weights = np.log(weights / weights.sum(axis=0))
    return Model(languages, weights.astype(np.float32), prior, orders)


def _scored(docs: DataFrame, model: Model, lang: str, score: str) -> DataFrame:
    """docs with the predicted language and its score in columns of these names."""
    # Plain values: what is broadcast is pickled by reference, and workers may not have this package.
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior, model.orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        grams = Grams(model.orders, len(model.weights))
        for batch in pieces(batches):
            langs, scores = model.predict(batch.column("text").to_pylist(), grams)
            yield batch.append_column(lang, pa.array(langs, pa.string())).append_column(score, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema)


def learned_from(docs: DataFrame) -> Model:
    """The model that the labelled rows of docs outside the held-out fold give."""
    return train(docs.filter(~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, ...).

    Null texts and texts without a letter are und with score 0, as is all if no row is labelled. A null doc_id is
    not held out. Repeated rows are each predicted; of equal scores the first language by name is taken; texts of any
    length are read in pieces; other columns are ignored; an empty table gives an empty result."""
    scored = _scored(docs.select("doc_id", F.col("text").cast("string")), learned_from(docs), "lang_pred", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text is in a language that is known, with `least_score` or more.

    The score is the share of the probability among the learned languages, so what goes is mostly texts without
    letters, and those that two languages claim: a text in a language that wasn't learned gets the nearest one. Null
    texts go, repeated rows stay or go together, and columns pass through, whatever their names."""
    columns = docs.columns
    lang, score = fresh(columns, "_lang"), fresh(columns, "_score")
    scored = _scored(docs.withColumn("text", F.col("text").cast("string")), learned_from(docs), lang, score)
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*columns)
