import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions import vectors
from trailweave.operators import learning, mining, sequences
from trailweave.sources import repositories

T0 = datetime(2024, 1, 1)


def rows_of(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), T0 + timedelta(minutes=rnd.randrange(n)), rnd.randrange(9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, s bigint, at timestamp_ntz, v int").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_neighbours_and_sums_over_ranges(spark, size):
    rows, df = rows_of(spark, 150)
    got = sequences.neighbours(df, "s", ["at", "id"], {"one": ("v", 1), "five": ("v", 5), "back": ("v", -1), "two": ("id", -2)}, size)
    got = {r.id: r for r in sequences.running(got, "s", F.col("v").cast("bigint"), "total", size).collect()}
    assert len(got) == 150
    for seq in by_key(rows).values():
        pick = lambda i, c: seq[i][c] if 0 <= i < len(seq) else None
        for i, r in enumerate(seq):
            g = got[r[0]]
            assert (g.ord, g.one, g.five, g.back, g.two) == (i + 1, pick(i + 1, 3), pick(i + 5, 3), pick(i - 1, 3), pick(i - 2, 0))
            assert g.total == sum(x[3] for x in seq[: i + 1])


def test_one_long_session_is_worked_on_by_many_tasks(spark):
    n = 300_000
    log = spark.range(n).select("id", F.lit(1).alias("session_id"), F.concat(F.lit("v"), (F.col("id") * 7 % 11).cast("string")).alias("vertex"), F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("at"))
    numbered = sequences.numbered(log, "session_id", ["at", "id"])
    assert numbered.filter("ord <> id + 1").count() == 0
    shares = sequences.in_ranges(numbered, ahead=5).groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("border").cast("int")).alias("b")).agg(F.count("*"), F.max("n"), F.max("b")).first()
    assert tuple(shares) == (-(-n // sequences.RANGE), sequences.RANGE + 5, 5)
    pairs = {(r.first_id, r.second_id): r.n for r in mining.ordered_pairs(log).collect()}
    want = {}
    for i in range(11):
        for k in range(1, 6):
            if i * 7 % 11 != (i + k) * 7 % 11:
                want[f"v{i * 7 % 11}", f"v{(i + k) * 7 % 11}"] = len(range(i, n - k, 11))
    assert pairs == want


def test_changes_and_idle_time_of_a_long_source(spark, monkeypatch):
    rows, df = rows_of(spark, 120, 5)
    monkeypatch.setattr(sequences, "RANGE", 4)
    readings = df.select(F.col("s").alias("source"), "at", "id", (F.col("v") % 3).cast("string").alias("value"))
    got = {r.id for r in learning.changes(readings).collect()}
    want = {r[0] for seq in by_key(rows).values() for p, r in zip([None, *seq], seq) if p is None or p[3] % 3 != r[3] % 3}
    assert got == want
    stretches = learning.by_idle_time(df.withColumnRenamed("s", "session_id").filter("session_id is not null"), 3)
    got = {r.id: r.session_id for r in stretches.collect()}
    for s, seq in by_key([r for r in rows if r[1]]).items():
        k = 0
        for p, r in zip([None, *seq], seq):
            k += p is None or r[2] - p[2] >= timedelta(minutes=3)
            assert got[r[0]] == f"{s}#{k}"


def brute_triangles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    return sorted((a, b, c) for a in near for b in near[a] for c in near.get(b, ()) if c in near[a])


@pytest.mark.parametrize("seed", range(3))
def test_triangles_by_degree(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({tuple(sorted(rnd.sample([f"n{i}" for i in range(14)], 2))) for _ in range(60)})
    got = mining.triangles(spark.createDataFrame(edges, "n1 string, n2 string"))
    assert sorted(map(tuple, got.collect())) == brute_triangles(edges)


def test_a_star_makes_no_wedge(spark):
    star = spark.range(100_000).select(F.lit("a hub").alias("n1"), F.concat(F.lit("leaf"), F.col("id")).alias("n2"))
    assert mining.wedges(mining.by_degree(star)).count() == 0
    both = star.unionByName(spark.createDataFrame([("leaf1", "leaf2")], "n1 string, n2 string"))
    assert [tuple(r) for r in mining.triangles(both).collect()] == [("a hub", "leaf1", "leaf2")]


LOG = """warning: what stands before isn't a commit
file.py
COMMIT:aaa1
DATE:100
MSG:first change

src/a.py
 src/b.py
COMMIT:bbb2
DATE:200
MSG:Merge branch

src/c.py
COMMIT:ccc3
DATE:300
MSG:noise only

node_modules/x.js
COMMIT:ddd4
MSG:no date: é

src/é.py
src/COMMIT:here.py
COMMIT:eee5
DATE:500
MSG:many

{}
COMMIT:fff6
DATE:600
MSG:last

src/z.py"""


def test_a_log_is_read_in_ranges_of_any_size(spark, tmp_path):
    text = LOG.format("\n".join(f"src/{i}.py" for i in range(21)))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "one.log").write_text(text)
    (tmp_path / "logs" / "two.log").write_text("COMMIT:2a\nDATE:1\nMSG:m\n\nx.py\n")
    lines = [(name, i, x) for name, t in (("one", text), ("two", (tmp_path / "logs" / "two.log").read_text())) for i, x in enumerate(t.split("\n"))]
    key = lambda r: (r.hash, r.timestamp, r.message, tuple(r.files))
    want = sorted(map(key, repositories.parsed_log(spark.createDataFrame(lines, "log string, line int, value string")).collect()), key=str)
    assert [w[0] for w in want] == ["2a", "aaa1", "ddd4", "fff6"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for step in [*range(1, 40), *range(41, len(text.encode()) + 2, 37)]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(step))
            got = repositories.logged_commits(spark, f"file://{tmp_path}/logs")
            assert sorted(map(key, got.coalesce(1).collect()), key=str) == want, step
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_vectors_as_bytes_and_back(spark):
    values = [[1.0, -2.5, float("inf")], [], [0.0, -0.0, 1e-45, 3.4e38], None, [float("nan")], [1.5, None], [2.0] * 300]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v array<float>").coalesce(1)
    got = vectors.with_vectors(vectors.with_bytes(df, "v", "b"), "b", "again").orderBy("k").collect()
    for r, v in zip(got, values):
        if v is None or None in v:
            assert r.b is None and r.again is None
        else:
            assert bytes(r.b) == np.array(v, "<f4").tobytes() and str(r.again) == str([float(np.float32(x)) for x in v])


def test_bytes_that_are_no_vector(spark):
    good = struct.pack("<2f", 1.0, 2.0)
    rows = [(0, bytearray(good)), (1, bytearray(good[:-1])), (2, None), (3, bytearray(b"")), (4, bytearray(b"x")), (5, bytearray(good * 2))]
    df = spark.createDataFrame(rows, "k int, b binary").coalesce(1)
    assert [r.v for r in vectors.with_vectors(df, "b", "v").orderBy("k").collect()] == [[1.0, 2.0], None, None, [], None, [1.0, 2.0, 1.0, 2.0]]
    assert vectors.with_vectors(df.limit(0), "b", "v").collect() == [] and vectors.with_vectors(df.filter("k % 2 = 1"), "b", "v").count() == 3
