"""The fold over stretches of time against the one over impulses, row by row."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_learning import fold, log_of
from trailweave.operators import folding, learning

COLUMNS = ["a", "b", "weight", "co_access_count", "last_fired"]


def rows(df):
    return {(r.a, r.b): (r.weight, r.co_access_count, r.last_fired) for r in df.select(*COLUMNS).collect()}


def same(got, want):
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 1e-12 and got[p][1:] == want[p][1:] for p in want)


@pytest.mark.parametrize("seed", [0, 1])
def test_stretches_of_any_length_are_the_fold(spark, monkeypatch, seed):
    """Sessions in blocks, stretches of a few accesses and batches that cut them give what the impulses in order give."""
    r = random.Random(seed)
    accesses = [(r.randrange(3) if i % 2 else 0, f"p{r.randrange(45)}", r.choice(("file", "tool", "error"))) for i in range(260)]
    for name, value in (("LONG", 40 + 200 * seed), ("BLOCK", 30), ("STRETCH", 150), ("ACCESSES", 16), ("BUCKET", 60)):
        monkeypatch.setattr(folding, name, value)
    want = fold(accesses)
    got = {(r.a, r.b): (r.weight, r.co_access_count) for r in learning.learned_pairs(log_of(spark, accesses)).collect()}
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 1e-12 and got[p][1] == want[p][1] for p in want)


def test_gathered_has_a_row_a_pair_and_stretch_not_one_an_impulse(spark):
    """What is dealt by pair doesn't grow with the impulses: 5,000 accesses to three vertices fire three pairs."""
    log = log_of(spark, [(i % 50, f"p{i % 3 if i % 7 else 0}") for i in range(5000)])
    cuts = folding.cuts_of(log)
    got = folding.gathered(folding.windows(log, None, 0, cuts), cuts)
    impulses = learning.impulses(log)
    assert got.agg(F.sum("n")).first()[0] == impulses.count() > 5000 and got.count() <= 3 * (len(cuts) + 1)
    same(rows(learning.learned_pairs(log)), rows(learning.folded(impulses)))


def test_what_has_no_vertex_time_or_session(spark):
    """Without a time an access is the first of its session, without a vertex it is in windows and no pair, and without a
    session in nothing."""
    log = log_of(spark, [(i % 2, f"p{i * i % 6}") for i in range(40)])
    log = log.withColumn("at", F.when(F.col("id") % 9 != 4, F.col("at"))).withColumn("vertex", F.when(F.col("id") % 11 != 3, F.col("vertex"))).withColumn("session_id", F.when(F.col("id") % 5 != 2, F.col("session_id")))
    same(rows(learning.learned_pairs(log)), rows(learning.folded(learning.impulses(log))))
