"""Registered queries against their oracles on the smallest tables, in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.correctness import compare
from trailweave.plans import registry

FAST = ["k01_learned_edges", "r06_recall", "m16_consolidation", "m15_decay_cycle", "k23_embed_missing", "s06_parsed_log", "k10_wired_errors", "k17_ignored", "l05_context_search", "j04_close_pairs", "a02_token_report", "m02_bridges", "r02_spread", "b01_cochanges", "f02_fingerprints", "s15_tool_calls", "t05_streamed_impulses"]


def test_names_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries) and all(oracles.values())


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", FAST)
def test_same_rows_as_sql(spark, name):
    good, said = compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")
    assert good, said
