import hashlib
import random
import re

import pytest

from trailweave.llm import decontaminate
from trailweave.llm.decontaminate import Automaton, normal_words, without_spans


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13, coverage=20):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit |= {*range(i, i + size)}
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and coverage * len(hit) >= len(words)


def test_automaton_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        items = [(str(i), " ".join(r.choice("ab c".split() if r.random() < 0.8 else "xyz") for _ in range(r.randrange(9)))) for i in range(6)]
        auto = Automaton.of([(i, normal_words(t)) for i, t in items], 4)
        text = " ".join(r.choice("abcxyz") for _ in range(120))
        n, spans, found = auto.hits(text)
        want = brute(text, items, 4)
        assert (n, sum(b - a for a, b in spans), len(found)) == want[:3] and [*spans] == sorted(spans)


def test_items_of_one_repeated_word():
    r = random.Random(5)
    for _ in range(40):
        items = [(str(i), " ".join([r.choice("ab")] * r.randrange(1, 9) + [r.choice("ab")] * r.randrange(3))) for i in range(5)]
        auto = Automaton.of([(i, normal_words(t)) for i, t in items], 4)
        text = " ".join(r.choice("aaab") for _ in range(60))
        n, spans, found = auto.hits(text)
        assert (n, sum(b - a for a, b in spans), len(found)) == brute(text, items, 4)[:3]


def test_a_long_item_of_one_word_is_no_square():
    auto = Automaton.of([("zeros", [b"0"] * 100_000), ("two", [b"0", b"0"])], 13)
    assert auto.hits("0 " * 50)[1:] == ([(0, 50)], {"zeros", "two"}) and auto.hits("0 0 1")[2] == {"two"}


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_edge_cases(spark, block_words):
    items = [(1, "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Ünï-code ÀB"), (2, "second of two"), (3, None), (None, "null item"), (None, "alpha beta gamma"), (4, "..."), (10, "twelve thirteen fourteen")]
    filler = " ".join(f"f{i}" for i in range(200))
    docs = [
        (1, "x one, two three! four five six seven eight nine ten eleven twelve thirteen y", "n", "h"),
        (2, filler + " Ünï code Àb " + filler, "n", "h"), (2, filler + " Ünï code Àb " + filler, "n", "h"),
        (3, None, None, None), (4, "", "", ""), (None, "null item second of two", "n", "h"), (7, "some alpha beta gamma here", "n", "h"), (5, "àb", "n", "h"),
        (6, ("word " * 300_000) + "second of two", "n", "h"),
    ]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string, n_words string, _hits string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.judged(frame, bench, block_words=block_words).collect()]
    assert sorted(map(str, got)) == sorted(str((d[0], *brute(d[1], items))) for d in docs)
    kept = {(r.doc_id, r.text) for r in decontaminate.clean(frame, bench, block_words=block_words).collect()}
    assert (2, filler + "  " + filler) in kept and {d for d, _ in kept} == {2, 3, 4, 5, 6}
    assert decontaminate.judged(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.judged(frame, bench.limit(0)).collect())


def test_spans_are_cut():
    assert without_spans("A, b! Ç d e", [(1, 3), (4, 5)]) == "A,  d "


def test_given_documents(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = [tuple(r) for r in bench.collect()]
    got = sorted(tuple(r) for r in decontaminate.judged(docs, bench).collect())
    assert got == sorted((r.doc_id, *brute(r.text, items)) for r in docs.collect()) and any(g[-1] for g in got)


def test_sql_agrees(spark):
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as from '/root/testdata/sf0.01/{t}.parquet'")
    want = sorted(duckdb.sql(decontaminate.ORACLE).fetchall())
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(tuple(r) for r in decontaminate.judged(docs, bench).collect()) == want


def test_long_items_and_held_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 2000)
    r = random.Random(5)
    words = [f"w{r.randrange(40)}" for _ in range(3000)]
    items = [(k, " ".join(words[a : a + n])) for k, (a, n) in enumerate([(0, 900), (500, 13), (2000, 1000), (100, 5)])]
    docs = [(i, " ".join(words[a : a + 60] if a % 3 else [f"z{a}", *words[a : a + 12], "y"])) for i, a in enumerate(range(0, 2900, 37))]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.judged(frame, bench, block_words=100).collect()
    assert sorted(map(tuple, got)) == sorted((d, *brute(t, items)) for d, t in docs) and len({r.contaminated for r in got}) == 2
