import duckdb
import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.llm import common, lines

CUT = re.compile(r"(?<=\n)|(?<=[.!?;:][\x20\x09-\x0D])")
SCHEMA = "doc_id bigint, text string, n_chars int, _gone string"


def brute(rows, min_words):
    """{(doc_id, text): (number of lines deleted, text left)} for (doc_id, text) pairs"""
    from xxhash import xxh64_intdigest

    def signed(t):
        x = xxh64_intdigest(t.encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))):
        every = CUT.split(text)
        worded = [(i, w) for i, x in enumerate(every) if (w := tuple(re.findall(r"[^\x20\x09-\x0D]+", x)))]
        gone = set()
        repeated = set()
        for k in range(len(worded)):
            n = 0
            for j in range(k, len(worded)):
                before, n = n, n + len(worded[j][1])
                # All runs of short texts; of long ones only those that are too short without an end.
                shortest = before < min_words or n - len(worded[k][1]) < min_words
                if not shortest and len(worded) > 100:
                    break
                if n >= min_words:
                    run = tuple(w for _, w in worded[k : j + 1])
                    if run in seen:
                        repeated |= {i for i, _ in worded[k : j + 1]}
                        gone |= {*range(worded[k][0], worded[j][0] + 1)} if shortest else set()
                    seen.add(run)
        assert repeated <= gone
        out[doc, text] = (len(gone), "".join(x for i, x in enumerate(every) if i not in gone))
    return out


def check(spark, rows, min_words=50):
    got = lines.dedup_lines(spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA), min_words)
    want = brute(rows, min_words)
    expected = [(d, *((0, None, 7) if t is None else (want[d, t][0], want[d, t][1], len(want[d, t][1]) if want[d, t][0] else 7)), "x") for d, t in rows]
    assert sorted(str((r.doc_id, r._deleted_lines, r.text, r.n_chars, r.a)) for r in got.withColumnRenamed("_gone", "a").collect()) == sorted(map(str, expected))
    return want


@pytest.mark.parametrize("min_words", [30, 34])
def test_against_brute_force(spark, min_words):
    r = random.Random(min_words)
    pool = [" ".join(r.choice(["a"] * 9 + ["b", "a.", "b;\t"]) for _ in range(n)) for n in (1, 1, 2, 3, 9, 11, 14)]
    rows = [(d, "\n".join(r.choice(["", *pool]) for _ in range(r.randrange(30)))) for d in range(60)]
    assert any(n for n, _ in check(spark, rows, min_words).values())


def test_edge_cases(spark):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(8))
    one = " ".join(f"v{i}" for i in range(50))
    rows = [(1, "head\n" + run), (2, "a b\n\n" + run.replace(" ", " \t") + "\r\ntail"), (2, "a b\n\n" + run.replace(" ", " \t") + "\r\ntail"), (3, one), (4, "x\n" + one + "\ny"), (5, one.rsplit(" ", 1)[0]), (6, one.rsplit(" ", 1)[0])]
    rows += [(7, None), (7, None), (8, ""), (9, "\n\n"), (None, one), (None, run), (10, f"{one}\n{one}\n{one}"), (4, one + "\nother"), (11, "\n".join(f"l{i} m{i % 7}" for i in range(20_000)) + "\n" + run)]
    rows += [(12, f"first\n{one} more\nits tail\nend"), (13, f"other\n{one} more\nits tail\nlast")]
    assert check(spark, rows)[rows[-1]] == (2, "other\nlast")
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    duckdb.sql(f"create or replace view documents as from '{path}'")
    want = sorted(duckdb.sql(lines.ORACLE).fetchall())
    assert sorted(tuple(r) for r in lines.report(spark.read.parquet(path)).collect()) == want and any(r[1] for r in want)


def test_passages_that_begin_and_end_inside_lines(spark):
    passage = "and this is what they share, whole and word by word. " + "It has marks, as prose has, here and there. " * 3 + "".join(f"Part {i} of it, number {i}. " for i in range(6)) + "so it ends"
    rows = [(1, "One begins so " + passage + " and goes on alone.\nMore of it."), (2, "Another\ntext with it: well, " + passage + " but ends otherwise"), (3, "Clean. Nothing shared, not at all.")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), 30).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and "number" not in got[2] and got[2].startswith("Another\ntext with it: well,")


def test_only_what_fingerprints_lead_to_is_extended(spark):
    text = "".join(f"Line {i} of the one, its own {i}.\n" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "x y z.\n" + text)], "doc_id bigint, text string")
    texts = lines.known_texts(docs, 30)
    at = lines.fingerprints(texts).groupBy("key").agg({"x": "collect_list"}).toDF("key", "xs")
    assert lines.passages(texts, at, 30).count() > 0 and lines.passages(texts, at.limit(0), 30).count() == 0
    assert at.selectExpr("sum(size(xs))").first()[0] < 0.8 * texts.selectExpr("sum(size(units))").first()[0]


def some_rows(seed):
    r = random.Random(seed)
    shared = [" ".join(f"w{r.randrange(50)}" + r.choice(["", "", "", ".", ";"]) for _ in range(60)) for _ in range(6)]
    own = lambda: " ".join(f"v{r.randrange(10**6)}" + r.choice(["", "", "."]) for _ in range(r.randrange(1, 40)))
    rows = [(d, "\n".join(r.choice([*shared, "", own()]) for _ in range(r.randrange(1, 7)))) for d in range(50)]
    return [*rows, *rows[:5], *((100 + d, t) for d, t in rows[:9])]


def test_runs_are_made_in_place(spark):
    # Windows over all lines of the texts took a third of the CPU seconds.
    texts = common.keep(lines.known_texts(spark.createDataFrame(some_rows(1), "doc_id bigint, text string"), 30))
    at = common.keep(lines.fingerprints(texts).groupBy("key").agg(F.collect_set("x").alias("xs")))
    plan = lines.passages(texts, at, 30)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 2


def test_positions_by_rows_and_by_crowded_bits(spark, monkeypatch):
    rows = some_rows(2)
    assert any(n for n, _ in check(spark, rows, 30).values())
    monkeypatch.setattr(lines, "CROWDED", -1)  # joined by rows
    check(spark, rows, 30)
    monkeypatch.undo()
    monkeypatch.setattr(common, "PLACES", 8)  # all bits are set
    check(spark, rows, 30)


def test_cuts_of_odd_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", ".", "?", ":", " ", "\n", *odd]) for _ in range(40)) for odd in ("", "\t", "\r\x0b\f", "\1", "\1\2\t") for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines._pieces(F.col("t")).alias("p"), lines._worded(F.col("t")).alias("u")).collect()
    hashes = {}
    for row in got:
        assert row.p == CUT.split(row.t)
        worded = [(i, w) for i, x in enumerate(row.p) if (w := tuple(re.findall(r"[^\x20\x09-\x0D]+", x)))]
        assert [(u.i, u.n) for u in row.u] == [(i, len(w)) for i, w in worded]
        for u, (_, w) in zip(row.u, worded):
            assert hashes.setdefault(u.h, w) == w
    assert len(set(hashes.values())) == len(hashes)
