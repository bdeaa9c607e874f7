"""Sources and reports beside their SQL: odd rows."""

import pytest

import __spark_entry__ as entry
from tests.correctness import compare
from trailweave.functions import scalars as S
from trailweave.operators import reports
from trailweave.plans import entries
from trailweave.schema import TOOL_CALL
from trailweave.sources import events

SF = "/root/testdata/sf0.001"
NAMES = ["s10_resolved_imports", "s14_sessions", "s16_tool_parts", "s28_extension_calls", "b04_every_seed", "k09_capped_contexts", "k09_appended_contexts", "a16_confusion", "a06_session_list", "r_budget_of_seeds", "k10_recorded_error", "l05_context_search_each", "t06_two_speed", "t10_recall_state", "k01_continued_edges", "f13_vector_bytes", "s06_log_in_ranges"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    good, said = compare(spark, name, entries.QUERIES[name], entries.ORACLES[name], SF)
    assert good, said


def test_all_queries_are_in_the_entry():
    assert set(entries.QUERIES) <= set(entry.queries()) and len(entries.QUERIES) > 150


def test_projects_of_folders(spark):
    rows = [("/home/me/work/",), ("work",), ("/",), ("",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.select(S.project_of(df.p)).collect()] == ["work", "work", None, None, None]


def test_calls_of_an_extension(spark):
    rows = [
        ("s", "Bash", {"command": "cat ~/a.py '/x/b.md' > /dev/null; ls"}, None, None), ("s", "bash", {}, "FAILED: at line 12:34:56 of 1234567890123", None), ("s", "EDIT", {"path": "/w/node_modules/c.js"}, "", None),
        ("s", "write", {"file_path": "/w/d.py"}, "Error: no", None), ("s", None, {}, "x", None), ("s", "", {}, "x", None), ("s", "Glob", None, "/w/e.py\n/w/e.py\nnot a path", None),
    ]
    got = events.from_extension(spark.createDataFrame(rows, TOOL_CALL)).collect()
    assert sorted((r.type, r.path, r.context) for r in got) == sorted([
        ("tool", "Bash", "tool:Bash"), ("tool", "bash:cat ~/a.py '/x/b.md' > /dev/null; ls", "bash:cat ~/a.py '/x/b.md' > /dev/null; ls"), ("file", "/root/a.py", "bash:cat ~/a.py '/x/b.md' > /dev/null; ls"), ("file", "/dev/null", "bash:cat ~/a.py '/x/b.md' > /dev/null; ls"),
        ("tool", "bash", "tool:bash"), ("error", "at line 12:N:N of ...", "bash"), ("tool", "EDIT", "tool:EDIT"), ("tool", "write", "tool:write"), ("file", "/w/d.py", "write:/w/d.py"), ("tool", "Glob", "tool:Glob"), ("file", "/w/e.py", "glob"),
    ])


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "query int, id string, type string")
    r = reports.confusion(none, none.drop("type"), spark.createDataFrame([(1,)], "query int")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (0, 0, 0, 1, 0.0, 0.0)
    assert reports.net_savings(spark.createDataFrame([], "access_count bigint, myelination double")).first().net_pct == 0.0
    assert reports.session_list(spark.createDataFrame([], "session_id int, ts timestamp_ntz, tool_input string, tool_result string")).collect() == []
