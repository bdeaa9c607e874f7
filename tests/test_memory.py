"""Queries that begin with the learned memory, on the smallest tables, against SQL."""

import pytest

from tests.correctness import compare
from trailweave.operators import learning
from trailweave.plans import registry

NAMES = ["m08_replayed", "k11_resolved_errors", "m12_directed", "r01_direct", "r06_recall"]


@pytest.mark.parametrize("name", NAMES)
def test_no_impulse_of_the_memory_is_a_row(spark, monkeypatch, tmp_path, name):
    """The memory is learned from stretches of time: impulses, of which a log has 24 an access, aren't numbered by pair."""

    def refused(*_):
        raise AssertionError("a row an impulse")

    monkeypatch.setattr(learning, "gathered", refused)
    # A memory of its own, so that none is there that another test has learned.
    monkeypatch.setattr(registry, "_store", lambda spark, sf_dir, kind: registry.continual.store(spark, f"file://{tmp_path}/{kind}"))
    good, said = compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")
    assert good, said
