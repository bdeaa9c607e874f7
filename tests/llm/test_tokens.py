import json
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trailweave.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH) as f:
        return tokens.ByteLevelCounter(json.load(f))


def strings():
    r = random.Random(1)
    letters = "aabeinotrst THE'sll  \n\t\r\x0b\x1c\x85\xa0 ,.!?#0123456789éßñ中文字🙂́١½²"
    for _ in range(3000):
        yield "".join(r.choice(letters) for _ in range(r.randrange(60)))
    yield from ["", " ", "  ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "  <|endoftext|>  z", "<|endoftext", " \n \n x", "\x00\x01"]


def test_same_as_the_library(library, counter):
    texts = [*strings()]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bounded_memory_paths_count_the_same(library, counter, monkeypatch):
    for name in ("KEPT_COUNTS", "SYMBOLS_AT_ONCE", "WORDS_AT_ONCE", "LONG_TEXT"):
        monkeypatch.setattr(tokens, name, 20)
    texts = [*strings()][::10]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("long", [1, 2, 5])
def test_places_by_rank_count_the_same(library, counter, monkeypatch, long):
    monkeypatch.setattr(tokens, "LONG_SEQUENCE", long)
    counter.known.clear()
    texts = [*strings()][::3]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pretokens(library, counter):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)), "".join(r.choice("etaoin") for _ in range(40_000)), "é" * 30_000, "=" * 30_000, "的" + "中文字" * 9000]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    began = time.time()
    counter.counts(["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))])
    assert time.time() - began < 60


def test_query(spark, library):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "a b", "x"), (1, None, None), (1, None, None), (7, "", ""), (8, "wörd " * 300_000, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(str, (tuple(r) for r in tokens.token_counts(frame, PATH).collect())))
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert got == sorted(str((d, len((t or "").encode()), n, n > 1024)) for (d, t, _), n in zip(rows, counts))
    assert tokens.token_counts(frame.limit(0), PATH).collect() == []
