import numpy as np
import pytest

from trailweave.operators import nearest


def made(n, width, clusters, seed, unit=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    m = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, width)) * 0.15
    return np.float32(m / np.linalg.norm(m, axis=1, keepdims=True) if unit else m)


def frames(spark, m, asked):
    rows = [(i, [float(x) for x in v] if v is not None else None, ["x", "y", None][i % 3]) for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<float>, g string").repartition(3)
    return vectors, spark.createDataFrame([(i, rows[i][1]) for i in asked], "query_id bigint, query array<float>")


def brute(m, asked, least, top):
    out = []
    for q in asked:
        if m[q] is not None:
            s = [(-min(1.0, max(-1.0, float(np.dot(np.float64(m[q]), np.float64(v))))), i) for i, v in enumerate(m) if v is not None]
            out += [(q, i, -c) for c, i in sorted(s)[:top] if -c >= least]
    return out


def check(spark, m, asked, least=0.2, top=5, **more):
    got = sorted((r.query_id, -round(r.confidence, 12), r.id) for r in nearest.similar_each(*frames(spark, m, asked), least, top, **more).collect())
    assert got == sorted((q, -round(c, 12), i) for q, i, c in brute(m, asked, least, top))


def test_clusters_are_left_out(spark):
    told = {}
    check(spark, made(1500, 16, 30, 1), range(0, 1500, 50), pivots=120, told=told)
    assert told["pairs"] == 1500 * 30 and told["computed"] < 0.5 * told["pairs"]


@pytest.mark.parametrize("unit", [True, False])
def test_without_structure_all_is_found(spark, unit):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 8))
    check(spark, np.float32(m / np.linalg.norm(m, axis=1, keepdims=True) if unit else m * 0.3), range(0, 400, 20), pivots=16)


def test_blocks_of_a_hot_cell_and_ties(spark, monkeypatch):
    for name, value in (("ROWS", 40), ("QUERIES", 6), ("AT_ONCE", 4)):
        monkeypatch.setattr(nearest, name, value)
    m = list(made(300, 6, 3, 3))
    m[50:250] = [m[50]] * 200
    check(spark, m, range(0, 300, 15), top=7, pivots=5)


def test_odd_vectors(spark):
    m = [np.float32(v) for v in ([0, 0, 0], [1, 0, 0], [0, 0, 0], [-1, 0, 0], [0.6, 0.8, 0])] + [None, np.float32([1, 0, 0])]
    check(spark, m, [0, 1, 3, 4, 5], least=-1.0, top=10)
    check(spark, m[:1], [0], least=0.0, top=3)
    check(spark, [None], [0])
    check(spark, m, [])


def test_the_best_of_each_group(spark):
    m, asked = made(200, 5, 4, 4), range(0, 200, 25)
    got = {(r.query_id, r.g): round(r.confidence, 12) for r in nearest.similar_each(*frames(spark, m, asked), 0.1, group="g").collect()}
    want = {}
    for q, i, c in brute(m, asked, 0.1, 1000):
        key = q, ["x", "y", None][i % 3]
        want[key] = max(want.get(key, -1), round(c, 12))
    assert got == want


def test_words_by_their_rarest_piece(spark):
    import random

    from trailweave.operators import postings, recall

    rnd = random.Random(1)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    rows = [(f"id{i}", rnd.choice(["file", "tool"]), rnd.choice(["src/ab", "b/aé.ts", None]), [" ".join(rnd.sample(words, 3)) for _ in range(rnd.randrange(3))], rnd.choice([0.1, 0.5, 0.7])) for i in range(40)]
    vertices = spark.createDataFrame(rows, "id string, type string, path string, contexts array<string>, myelination double")
    asked = [(k, " ".join(rnd.sample(words, 2)).upper()) for k in range(25)] + [(90, ""), (91, None), (92, "zzz nowhere ab")]
    for paths, top in ((False, 3), (True, 50)):
        got = postings.matches_each(vertices, spark.createDataFrame(asked, "query_id int, text string"), top, paths)
        want = {(k, r.id) for k, q in asked[:12] + asked[25:] if q is not None for r in recall.context_matches(vertices, q, top, paths).select("id").collect()}
        assert {tuple(r) for r in got.collect() if r.query_id in {k for k, _ in asked[:12] + asked[25:]}} == want
