import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trailweave.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, _words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def texts():
    r = random.Random(2)
    yield from [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c x a b c", "é|ß <b>&\x85 \x0b# \r\nx\n\nx\r\n x\nx", "\n".join(["same line"] * 9), "😀 𝒳 y" * 3, "w " * 100_000 + " ".join(map(str, range(50_000)))]
    for _ in range(150):
        yield "".join(r.choice("ab  \n#é") for _ in range(r.randrange(200)))


def test_statistics(spark):
    rows = [(i, t, None, None, "x", 1) for i, t in enumerate(texts())] * 2
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {d: brute(t) for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        n_words, *_, n_repeat = want[r.doc_id]
        assert tuple(r[1:6]) == want[r.doc_id], rows[r.doc_id][1]
        assert r.base_failed == (n_words < 50 or 100 * n_repeat > 50 * n_words) and not (r.base_failed and r.kept)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).collect() == []


LEAST = np.diag(np.array([*quality.FEATURES.values()]) ** 2)


def distance(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def mcd(x, seed=0, share=0.75):
    """Mean, covariance with least spreads and determinant's root of the best of 200 random starts, in numpy."""
    r, best = np.random.default_rng(seed), None
    for _ in range(200):
        rows = x[r.choice(len(x), 5, replace=False)]
        for _ in range(25):
            m, c = rows.mean(0), np.cov(rows.T, bias=True) + LEAST
            rows = x[np.argsort(distance(x, m, c))[: math.ceil(len(x) * share)]]
        det = math.sqrt(np.linalg.det(c))
        if best is None or det < best[0]:
            best = det, m, c
    return best


def frame(spark, groups):
    rows = [(*key, int(h), *map(float, v)) for key, x in groups.items() for v, h in zip(x, np.random.default_rng(1).integers(-(1 << 62), 1 << 62, len(x)))]
    return spark.createDataFrame(rows, "g_lang string, g_source string, h bigint, " + ", ".join(f"{f} double" for f in quality.FEATURES))


def planted(n_good, n_bad, seed):
    r = np.random.default_rng(seed)
    good = r.normal([1.5, 0.1, 0.2, 0.1], [0.1, 0.1, 0.2, 0.3], (n_good, 4))
    good[:, 3] += good[:, 2]
    return np.vstack([good, r.normal([3, 0.9, 0.2, 0.1], 0.05, (n_bad, 4))])


def test_estimates_against_numpy_with_a_quarter_of_clustered_outliers(spark):
    groups = {("a", "x"): planted(900, 300, 4), ("b", "x"): planted(60, 19, 5), ("b", "y"): planted(3000, 0, 6), ("c", "y"): np.tile([[1.5, 0.0, 0.0, 0.0]], (200, 1))}
    rows = frame(spark, groups)
    found = {(r.g_lang, r.g_source): r for r in quality.estimates(rows).collect()}
    names = [*quality.FEATURES]
    assert found.keys() == groups.keys()
    for key, x in groups.items():
        det, m, c = mcd(x)
        got = found[key]
        plain = np.array([[got[f"c_{a}_{b}"] if j <= i else got[f"c_{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)])
        # Steps of the histogram let a few rows more in than numpy's exact quantile.
        assert math.sqrt(np.linalg.det(plain + LEAST)) < det * 1.06, key
        assert np.allclose([got[f"m_{a}"] for a in names], m, atol=0.03), key
        low = np.array([[got[f"l_{a}_{b}"] if j <= i else 0.0 for j, b in enumerate(names)] for i, a in enumerate(names)])
        scale = max((np.median(distance(x, m, plain + LEAST)) / quality.CHI2_MEDIAN), 1)
        assert np.allclose(low @ low.T, plain * scale + LEAST, rtol=0.1, atol=2e-3), key
    d2 = quality._with_distance(rows.join(quality.estimates(rows), ["g_lang", "g_source"])).filter(F.col("d2") > quality.CUTOFF).groupBy("g_lang", "g_source").count()
    n = {tuple(r)[:2]: r[2] for r in d2.collect()}
    assert n.pop(("b", "y"), 0) <= 3 and n == {("a", "x"): 300, ("b", "x"): 19}


def test_each_statistic_can_reject():
    assert all(most / least > math.sqrt(quality.CUTOFF) for least, most in zip(quality.FEATURES.values(), (1.0, 1.0, 1.0, math.sqrt(0.5))))


def test_groups_pooling_and_verdicts(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(3, 8)))
    text = lambda: " ".join(word() for _ in range(80))
    odd = "".join(f"{word()}{i} #$% {word()} " for i in range(80))
    rows = [(i, text(), "en", "big", "", 0) for i in range(60)] + [(100 + i, text(), "en", f"small{i % 9}", "", 0) for i in range(54)] + [(200 + i, text(), None, None, "", 0) for i in range(5)]
    rows += [(300, odd, "en", "big", "", 0), (301, odd, "en", "small1", "", 0), (302, odd, None, None, "", 0), (303, "same words here " * 40, "en", "big", "", 0), (304, "few", "en", "big", "", 0)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[300].kept and not got[301].kept and got[302].kept and got[302].distance is None
    assert [got[d].base_failed for d in (300, 303, 304)] == [False, True, True] and not got[303].kept and not got[304].kept
    assert all(got[i].kept for i in [*range(60), *range(100, 154), *range(200, 205)])


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()
    n = {(r.quality, r.kept): r.n for r in got}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9
