import re
import zlib
from collections import Counter
from math import exp, log

import pytest

from trailweave.llm import language

SCHEMA = "doc_id bigint, text string, lang string, lang_pred string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog", "en", "x") for i in range(8)] + [(i, "der hund und die katze", "de", "x") for i in range(8, 16)]
    rows += [(20, None, "en", "x"), (21, "", None, None), (22, "12 !? \n", "de", ""), (23, "THE DOG!!", None, ""), (23, "THE DOG!!", None, ""), (None, "und die", None, ""), (24, "the " * 200_000, None, ""), (25, "中文", None, "")]
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score > 0) for r in got}
    assert by[20] == by[21] == by[22] == ("und", False)
    assert by[23] == by[24] == ("en", True) and by[None] == ("de", True) and by[25][0] in ("en", "de")
    kept = language.recognised(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in kept} >= {*range(16), 23, 24, None} and not {20, 21, 22} & {r.doc_id for r in kept}
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "lang_pred"]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language.identify(frame).collect()] == [("und", 0.0)]
    assert language.identify(frame.limit(0)).collect() == []


def by_hand(text, orders=3, buckets=1 << 15):
    """Buckets of the n-grams of a text, each hashed by itself."""
    flat = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    out = Counter()
    for n in range(1, orders + 1):
        for i in range(len(flat) - n + 1):
            code = 0
            for k, c in enumerate(flat[i : i + n]):
                code = (code * 0x01000193 + ord(c) + k + 1) % 2**32
            code = (code ^ code >> 15) * 0x85EBCA6B % 2**32
            if flat[i : i + n] != " ":
                out[(code >> 8) % buckets] += 1
    return out


@pytest.mark.parametrize("at_once", [1, 2, 7, 64, 1 << 18])
def test_ngrams_by_hand_across_pieces(monkeypatch, at_once):
    monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", at_once)
    grams = language.Grams(3, 1 << 15)
    texts = ["the Cat, and  12 the DOG ", "", "a", None, " x ", "Übermäßig \n\n langes Wort" * 5, "ΑΣ Σ", "?!"]
    got = [Counter() for _ in texts]
    for owner, bucket in grams.batches(texts):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            got[o][b] += 1
    assert got == [by_hand(t) if t else Counter() for t in texts]


def test_many_languages(spark):
    rows = [(i, f"text number {i}", f"dirty{i}", "x") for i in range(1001)] + [(i, "der hund und die katze", "de", "x") for i in range(2000, 2010)] + [(i, "the cat and the dog", "en", "x") for i in range(3000, 3020)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert language.train(frame, max_languages=2).languages == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in language.identify(frame).collect()}
    assert got[2001] == "de" and got[3001] == "en" and len(got) == len(rows)


def test_same_as_counting_by_hand(spark, monkeypatch):
    monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", 8)
    rows = [("ab cab bca", "x"), ("zz za", "y"), ("ab ab", "x"), ("zab zz", "y")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), buckets=64)
    counted = lambda texts: sum((by_hand(t, buckets=64) for t in texts), Counter())
    for k, lang in enumerate(model.languages):
        c = counted([t for t, own in rows if own == lang])
        assert all(abs(model.weights[b, k] - log((c[b] + 0.5) / (sum(c.values()) + 32))) < 1e-5 for b in range(64))
    texts = ["ab", "zz zz", "b z a"]
    for text, got, score in zip(texts, *model.predict(texts, language.Grams(3, 64))):
        want = [model.prior[k] + sum(n * model.weights[b, k] for b, n in counted([text]).items()) / 3 for k in range(2)]
        assert got == model.languages[want.index(max(want))] and abs(score - 1 / sum(exp(w - max(want)) for w in want)) < 1e-4
