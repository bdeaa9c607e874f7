import math

import numpy as np
import pytest

from trailweave.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, copy int"


def brute(rows):
    """Sorted result rows of (vec_id, vector, label) rows, one anchor after the other."""
    given = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            given.add((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in sorted(given):
        if i % 100:
            continue
        order = sorted({(-dot(v, w), j, m) for j, m, w in given if (j, m, w) != (i, label, v)})
        for p, j, m in [x for x in order if x[2] == label and x[1] != i][:5]:
            window = [x for x in order if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(window)]
    return sorted(out)


def check(spark, rows):
    got = negatives.report(spark.createDataFrame([(*r, "q", 9) for r in rows], SCHEMA))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    said = sorted(tuple(r) for r in got.collect())
    assert said == brute(rows)
    return said


def made(n, seed, width=7, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=width)
    return [(i, [float(x) for x in np.float32(base + rng.normal(size=width) * 0.7)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (16, 16, 16), (17, 17, 17), (33, 64, 71), (100, 7, 3), (129, 65, 257)])
def test_product_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 27), 1 << 27, (m, k)), rng.integers(-(1 << 27), 1 << 27, (k, n))
    assert (negatives.product(a, b) == a @ b).all()


def test_product_is_exact_where_sums_on_the_way_overflow():
    a = np.full((40, 40), (1 << 62) - 1)
    b = np.eye(40, dtype=np.int64)
    assert (negatives.product(a, b) == a).all() and (negatives.product(np.rot90(a * -1 + 3), b) == np.rot90(a * -1 + 3)).all()


def test_heaps_break_ties_by_place():
    scores = np.array([[5, 7, 7, 5, 7, 1], [negatives.NONE, 2, negatives.NONE, 2, 2, 2]])
    r, c = negatives.heaps(scores, 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 3)]


def test_same_as_brute_force_over_many_tiles(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 150), ("TILE_ANCHORS", 3), ("TILE_ROWS", 40)):
        monkeypatch.setattr(negatives, name, value)
    assert len(check(spark, made(900, 3))) > 100


def test_ties_repeats_and_odd_rows(spark):
    rows = made(320, 5, width=2, labels=2)
    rows += rows[:110] + [(0, [1.0, 1.0], 1), (100, [0.5, 0.25], 0), (200, [0.5, 0.25], 3)]
    rows += [(None, [1.0, 1.0], 1), (400, None, 1), (500, [1.0, None], 1), (600, [float("nan"), 1.0], 1), (700, [float("inf"), 1.0], 1), (800, [1.0, 1.0], None), (900, [], 1), (1000, [0.0], 1), (1100, [2.0, 1.0, 3.0], 0)]
    rows += [(2000 + i, [0.5, 0.5], i % 2) for i in range(400)]
    check(spark, rows)


def test_lone_anchors_and_empty_tables(spark):
    check(spark, [(100, [1.0, 1.0], 1), (101, [1.0, 0.5], 2)])
    assert check(spark, [(100, [1.0, 1.0], 1), (101, [-1.0, 0.5], 1), (102, [1.0, 0.0], 2)]) == []
    assert negatives.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_too_long_for_a_bigint_take_no_part(spark):
    rows = [(100, [1.0, 1.0], 1), (101, [1.0, 0.5], 1), (102, [0.5, 0.25], 2)]
    huge = [(103, [3e7, 1.0], 2), (104, [1e30, 1.0], 1)]
    got = negatives.report(spark.createDataFrame([(*r, "q", 9) for r in rows + huge], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and got
