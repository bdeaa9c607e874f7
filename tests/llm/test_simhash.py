import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from trailweave.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, n int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fp) pairs"""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    least = defaultdict(list)
    for d, p in prints:
        if d is not None:
            least[find(p)].append(d)
    return {(d, p): min(least[find(p)], default=None) for d, p in prints}


def check(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = brute_components(prints)
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(map(str, ((d, f"{p:016x}", want[d, p]) for d, p in prints)))


def test_edge_cases(spark):
    text = "One two three four five six seven " * 3
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, " \t\n"), (6, "a"), (7, "A b"), (None, text), (8, "É x\x85y z"), (9, text.upper())]
    check(spark, [(*r, "clash", 1) for r in rows])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_long_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 50)
    text = " ".join(f"w{i * i % 977}" for i in range(400_000))
    assert simhash._fingerprints([text, "a b c d", None], 3, 42).view("uint64").tolist() == [brute_print(text), brute_print("a b c d"), 0]


@pytest.mark.parametrize("paired", [48, 2])
def test_links_are_complete(spark, monkeypatch, paired):
    """Dense balls, where keys hold many fingerprints; paired=2 sends nearly all through the second dealing."""
    import random

    monkeypatch.setattr(simhash, "PAIRED_MEMBERS", paired)
    r = random.Random(5)
    prints = set()
    for centre in (0, r.getrandbits(64), r.getrandbits(64)):
        for _ in range(150):
            p = centre
            for _ in range(r.randrange(7)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    from trailweave.llm.common import connected_components

    edges = simhash.links(df)
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    got = defaultdict(set)
    for row in connected_components(edges).collect():
        got[row.root].add(row.node % (1 << 64))
    want = defaultdict(set)
    for (p, _), c in brute_components([(p, p) for p in prints]).items():
        want[c].add(p)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


@pytest.mark.parametrize("paired", [16, 1])
def test_no_task_makes_the_keys_of_many_fingerprints(spark, monkeypatch, paired):
    """All fingerprints are in one partition, as after a grouped sum of few MB; keys are made in as many tasks as they need."""
    monkeypatch.setattr(simhash, "DEALT", 64, raising=False)
    monkeypatch.setattr(simhash, "PAIRED_MEMBERS", paired)
    kept = []
    monkeypatch.setattr(simhash, "keep", lambda df: kept.append(df) or df)
    prints = spark.range(0, 1024, 1, 1).select(F.xxhash64(F.col("id") - F.col("id") % 2).bitwiseXOR(F.col("id") % 2).alias("fp"))
    edges = simhash.links(prints)
    assert edges.count() == 512
    made = kept[0].select("fp", F.spark_partition_id().alias("p")).distinct()
    assert made.select("fp").distinct().count() == 1024
    for df in (kept[0], edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(fp" in plan and ", 16), REPARTITION_BY_NUM" in plan


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text, "", 0) for r in docs.collect()])
