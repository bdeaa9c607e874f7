import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trailweave.llm import mixing
from trailweave.llm.mixing import Targets

SCHEMA = "doc_id bigint, text string, source string, block string, _key int"


def frame(spark, sizes):
    """Texts of 1 to 5 words; sizes: texts by source."""
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, "w " * (k % 5 + 1), source, "x", 1))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("targets", [Targets(), Targets(entropy=1.0), Targets(max_repeats=1.5, entropy_share=1.0), Targets(budget=700.0, max_repeats=9.0), Targets(entropy_share=0.0)])
def test_against_brute_force(spark, targets):
    docs = frame(spark, {"a": 200, "b": 60, "c": 17, None: 30})
    rows = docs.collect()
    t = Counter()
    for r in rows:
        t[r.source] += len(r.text.split())
    p = {s: n / sum(t.values()) for s, n in t.items()}

    def mixture(a):
        z = sum(x**a for x in p.values())
        w = {s: x**a / z for s, x in p.items()}
        budget = targets.budget or max(t[s] / w[s] for s in w)
        return -sum(x * math.log(x) for x in w.values()), max(w[s] * budget / t[s] for s in w), {s: w[s] * budget for s in w}

    most = targets.entropy or mixture(1)[0] + targets.entropy_share * (mixture(0)[0] - mixture(1)[0])
    fits = lambda a: mixture(a)[0] <= most + 1e-9 and mixture(a)[1] <= targets.max_repeats + 1e-9
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    quota = mixture(high if fits(high) or high < 1 else 1.0)[2]

    out = mixing.mix(docs, targets).collect()
    used, blocks = Counter(), defaultdict(list)
    for r in out:
        used[r.source] += len(r.text.split())
        blocks[r.source, r.block].append((r.place, r.doc_id, len(r.text.split())))
    for s in t:
        assert -1e-3 <= used[s] - math.floor(quota[s] + 1e-3) < 5 + 1e-3 or abs(used[s] - quota[s]) < 5
        own = sorted(b for x, b in blocks if x == s)
        assert own == [*range(len(own))]
        for b in own[:-1]:
            assert sorted(d for _, d, _ in blocks[s, b]) == sorted(r.doc_id for r in rows if r.source == s)
        everyone = sorted((int(__import__("hashlib").md5(f"{r.doc_id}:{own[-1]}:17".encode()).hexdigest()[:15], 16), r.doc_id) for r in rows if r.source == s)
        assert sorted(x[:2] for x in blocks[s, own[-1]]) == everyone[: len(blocks[s, own[-1]])]
    if not targets.budget:
        assert {r.doc_id for r in out} == {r.doc_id for r in rows}


def test_edge_cases(spark):
    rows = [(1, None, "empty", "x", 1), (2, "", "empty", "x", 1), (3, "a b", "s", None, None), (3, "a b", "s", None, None), (None, "c " * 50_000, "s", "", 0), (5, "x", None, "", 0), (6, None, "s", "", 0)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    first = [r for r in out if r.block == 0]
    assert sorted(map(str, (r.doc_id for r in first))) == sorted(str(r[0]) for r in rows)
    assert out[0].__fields__ == ["doc_id", "text", "source", "_key", "block", "place"]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame(rows[:2], SCHEMA)).count() == 2


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"create or replace view documents as from '{path}'")
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall())
    docs = spark.read.parquet(path)
    got = mixing.report(docs)
    assert sorted(tuple(r) for r in got.select("doc_id", "source", "n_words", "block", "place").collect()) == want
    assert got.filter("block = 0").count() == docs.count() and got.agg(F.max("block")).first()[0] >= 1
