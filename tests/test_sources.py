"""Scalar functions and sources on literal inputs."""

from pyspark.sql import functions as F

from trailweave import schema
from trailweave.functions import scalars as S
from trailweave.sources import events, repositories, snippets
from trailweave.streaming import jobs


def each(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_errors(spark):
    a, b = each(spark, S.normalize_error, ["TypeError: 'x' of null at f.ts:12:5 line 42", "TypeError: 'yy' of null at f.ts:99:1 line 7"])
    assert a == b == "TypeError: 'VAR' of null at f.ts:X:X line X"
    assert each(spark, S.error_fingerprint, ["TypeError: Cannot read property 'foo' of null", "odd", "connect ECONNREFUSED"]) == ["TYPE_ERROR|property_access", "GENERIC_ERROR|unknown", "CONNECTION_REFUSED|connecting"]
    got = each(spark, S.detect_output_error, ["short", "x" * 3000 + "\nError: cannot open pid 123 on port 80", "all good here, nothing", 'x {"error": "the token 12345678901 expired"}', None])
    assert got == [None, "cannot open pid ... on port ...", None, "the token ... expired", None]


def test_names_and_paths(spark):
    assert each(spark, S.group_key, ["/a/Auth.test.ts", "auth.css", "x.stories.test.js", "noext"]) == ["auth", "auth", "x.test", "noext"]
    assert each(spark, S.is_skipped, ["/a/node_modules/x.js", "/a/b.ts", "/a/x~"]) == [True, False, True]
    assert each(spark, S.is_skipped_in_bulk, ["dist/a.js", "a.PNG", "x/package.json", "a.min.js", "src/a.ts"]) == [True, True, True, True, False]
    assert each(spark, S.resolved, ["~/a", "/b"]) == ["/root/a", "/b"]
    assert each(spark, repositories.normal_path, ["/a/./b/../c", "a/../../b"]) == ["/a/c", "b"]
    assert each(spark, lambda c: S.first_distinct(c, 2), [["a", "b", "a", "c"]], "array<string>") == [["b", "c"]]


def test_change_log(spark):
    text = "noise\nCOMMIT:h1\nDATE:5\nMSG:fix it\n\nsrc/a.ts\nsrc/b.ts\ndist/c.js\n\nCOMMIT:h2\nDATE:6\nMSG:Merge x\nsrc/a.ts\nCOMMIT:h3\nDATE:7\nMSG:none"
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text.split("\n"))], "log string, line int, value string")
    assert [tuple(r) for r in repositories.parsed_log(lines).collect()] == [("r", "h1", 5, "fix it", ["src/a.ts", "src/b.ts"])]


def test_imports(spark):
    files = spark.createDataFrame([("src/a.ts", "import x from './b'\nconst y = require('../lib')\nimport z from \"pkg\"\nimport q from './c.js'"), ("src/b.tsx", ""), ("lib/index.js", ""), ("src/c.ts", ""), ("src/b.js", "")], "file string, text string")
    got = repositories.resolved_imports(repositories.imports(files), files)
    assert sorted(map(tuple, got.collect())) == [("src/a.ts", "lib/index.js"), ("src/a.ts", "src/b.tsx"), ("src/a.ts", "src/c.ts")]


def test_notes(spark):
    notes = spark.createDataFrame([('{"a": ["b", "c"], "d": []}',), ("bad",)], "value string")
    assert sorted(map(tuple, repositories.noted_links(notes).collect())) == [("a", "b"), ("a", "c")]


def test_listed_files(spark, tmp_path):
    (tmp_path / "dist").mkdir()
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "dist" / "b.py").write_text("y")
    got = repositories.listed_files(spark, f"file://{tmp_path}", "*.py").collect()
    assert [(r.file, r.text) for r in got] == [(f"{tmp_path}/a.py", "x = 1")]


def test_tool_calls(spark):
    lines = ['{"session_id": "s", "tool_name": "Edit", "tool_input": {"file_path": "/a.ts", "old_string": "x\\ny"}}', '{"session_id": "s", "tool_name": "Bash", "tool_input": {"command": "cat /b.ts ~/c.ts"}, "tool_result": "Error: this went really wrong"}', "not json", '{"tool_name": ""}']
    got = events.from_calls(events.from_json(spark.createDataFrame([(v,) for v in lines], "value string"), schema.TOOL_CALL))
    assert [tuple(r) for r in got.select("type", "path", "context").collect()] == [("tool", "Edit", "edit:x y"), ("file", "/a.ts", "edit:x y"), ("tool", "Bash", "bash:cat /b.ts ~/c.ts"), ("file", "/b.ts", "bash:cat /b.ts ~/c.ts"), ("file", "/root/c.ts", "bash:cat /b.ts ~/c.ts"), ("error", "this went really wrong", "bash:cat /b.ts ~/c.ts")]


def test_tool_parts(spark):
    part = '{"type": "tool_use", "part": {"tool": "%s", "state": {"status": "%s", "input": {"query": "q", "path": "/p.py"}, "output": "/x.py:3: hit\\nError: this went really wrong"}}}'
    lines = [part % ("search", "completed"), part % ("shell", "running"), part % ("read_file", "completed")]
    got = events.from_parts(events.from_json(spark.createDataFrame([(v,) for v in lines], "value string"), schema.TOOL_PART))
    assert [tuple(r) for r in got.select("type", "path", "context").collect()] == [("tool", "search", "grep:q"), ("file", "/x.py", "grep:q"), ("tool", "read_file", "read_file"), ("file", "/p.py", "read_file")]


def test_transcripts(spark):
    line = '{"timestamp": "%s", "message": {"content": [{"type": "tool_use", "name": "%s", "input": {"file_path": "%s"}}]}}'
    rows = [("s", line % (1, "Read", "/a")), ("s", line % (2, "Edit", "/b")), ("t", line % (1, "Read", "/a")), ("s", line % (3, "Bash", "/z")), ("s", line % (4, "Read", "/private/tmp/x"))]
    got = events.sessions_from_transcripts(spark.createDataFrame(rows, "session_id string, value string"))
    assert sorted((r.session_id, r.file) for r in got.collect()) == [("s", "/a"), ("s", "/b")]


def test_snippets(spark):
    python = "class A:\n    def m(self):\n        a = 1\n        b = 2\n        c = 3\n        return a\n\ndef short():\n    pass\n"
    ts = "export function f(x) {\n  if (x) {\n    return '}';\n  }\n  return 1;\n}\nconst g = (a) => {\n  1;\n  2;\n  3;\n};\nclass K {\n  run(a) {\n    x();\n    y();\n    z();\n  }\n}\n"
    files = spark.createDataFrame([("a.py", python), ("b.ts", ts), ("c.txt", ts), ("d.py", "def ("), ("e.rs", None)], "file string, text string")
    got = snippets.extract(files)
    assert sorted((r.parent, r.kind, r.name, r.start_line, r.end_line) for r in got.collect()) == [("file:a.py", "class", "A", 1, 6), ("file:a.py", "method", "m", 2, 6), ("file:b.ts", "class", "K", 12, 18), ("file:b.ts", "function", "f", 1, 6), ("file:b.ts", "function", "g", 7, 11), ("file:b.ts", "method", "run", 13, 17)]
    again = snippets.upserted(got, snippets.extract(spark.createDataFrame([("a.py", "def new():\n" + "    x = 1\n" * 5)], "file string, text string")))
    assert sorted(r.name for r in again.collect()) == ["K", "f", "g", "new", "run"]


def test_recorder_takes_files_once_a_batch(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vertex": ["f:1", "f:1", "t:1", "t:1"], "type": ["file", "file", "tool", "tool"]}), tmp_path / "x.parquet")
    stream = spark.readStream.schema("vertex string, type string").parquet(f"file://{tmp_path}")
    seen = []
    q = jobs.recorded(stream, f"file://{tmp_path}/checkpoint", lambda batch, n: seen.append(sorted(r.vertex for r in batch.collect())))
    q.processAllAvailable()
    q.stop()
    assert seen == [["f:1", "t:1", "t:1"]]
