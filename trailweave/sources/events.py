"""Accesses out of events of tools, as JSON lines tell them: (session_id, at, type, path, context)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Names of tools of both families by what they do: fixed values.
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit", "read_file", "write_file")
SEARCH_TOOLS = ("Grep", "search")
LIST_TOOLS = ("Glob", "list_files")
SHELL_TOOLS = ("Bash", "bash", "shell")
SESSION_TOOLS = ("Read", "Edit", "Write", "Glob", "Grep")
MOST_PATHS = 10


def from_json(lines: DataFrame, ddl: str) -> DataFrame:
    """Rows of lines (value) as ddl says; lines that are no such JSON are left out."""
    return lines.select(F.from_json("value", ddl).alias("e"), F.col("value")).filter(F.col("e").isNotNull()).select("e.*")


def _given(given: Column, *names: str) -> Column:
    return F.coalesce(*(F.when(given[n] != "", given[n]) for n in names))


def context_of(tool: Column, given: Column) -> Column:
    """What a call was about."""
    pattern = lambda mark, *names: F.coalesce(F.concat(F.lit(f"{mark}:"), _given(given, *names)), tool)
    edited = F.regexp_replace(F.substring(_given(given, "old_string", "old_text"), 1, 60), "\n", " ")
    ran = F.substring(_given(given, "command", "cmd"), 1, 80)
    return (
        F.when(tool.isin(*SEARCH_TOOLS), pattern("grep", "pattern", "query"))
        .when(tool.isin(*LIST_TOOLS), pattern("glob", "pattern", "glob"))
        .when(tool == "Edit", F.coalesce(F.concat(F.lit("edit:"), edited), tool))
        .when(tool.isin(*SHELL_TOOLS), F.coalesce(F.concat(F.lit("bash:"), ran), tool))
        .otherwise(tool)
    )


def paths_of(tool: Column, given: Column, output: Column, home: str = "/root") -> Column:
    """The files that a call was about, ten at most, without noise."""
    lines = F.filter(F.transform(F.split(output, "\n"), F.trim), lambda x: x != "")
    none = F.array().cast("array<string>")
    one = _given(given, "file_path", "path", "notebook_path")
    hits = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^(/[^\s:]+)", 1)), lambda p: p != "")
    mentioned = F.transform(F.regexp_extract_all(_given(given, "command", "cmd"), F.lit(r"(?:^|\s)((?:/|~/)[^\s;|&>]+)"), 1), F.trim)
    found = F.when(tool.isin(*FILE_TOOLS), F.array_compact(F.array(one))).when(tool.isin(*SEARCH_TOOLS), hits).when(tool.isin(*LIST_TOOLS), lines).when(tool.isin(*SHELL_TOOLS), mentioned)
    kept = F.filter(F.array_distinct(F.coalesce(found, none)), S.is_absolute)
    return F.slice(F.filter(F.transform(kept, lambda p: S.resolved(p, home)), lambda p: ~S.is_skipped(p)), 1, MOST_PATHS)


def _accesses(calls: DataFrame, errors: Column) -> DataFrame:
    """calls: (session_id, at, tool, given, output)."""
    tool, given = F.col("tool"), F.col("given")
    calls = calls.withColumn("error", F.when(errors, S.detect_output_error(F.col("output")))).withColumn("paths", paths_of(tool, given, F.col("output")))
    named = lambda kind, paths: F.transform(paths, lambda p: F.struct(F.lit(kind).alias("type"), p.alias("path")))
    events = F.concat(named("tool", F.array(tool)), named("file", F.col("paths")), named("error", F.array_compact(F.array("error"))))
    return calls.select("session_id", "at", F.posexplode(events).alias("n", "e"), context_of(tool, given).alias("context")).select("session_id", "at", "n", "e.type", "e.path", "context")


def from_calls(calls: DataFrame) -> DataFrame:
    """Of calls as schema.TOOL_CALL: the tool, its files, and an error in any tool's result."""
    named = calls.filter("tool_name is not null and tool_name <> ''").select("session_id", "at", F.col("tool_name").alias("tool"), F.col("tool_input").alias("given"), F.col("tool_result").alias("output"))
    return _accesses(named, F.lit(True))


def from_parts(parts: DataFrame) -> DataFrame:
    """Of events as schema.TOOL_PART: completed uses only, and errors of shells only."""
    done = parts.filter("type = 'tool_use' and part.state.status = 'completed'")
    named = done.select("session_id", "at", F.coalesce("part.tool", F.lit("unknown")).alias("tool"), F.col("part.state.input").alias("given"), F.col("part.state.output").alias("output"))
    return _accesses(named, F.col("tool").isin(*SHELL_TOOLS))


#: Errors in what a call gave, as an extension tells them: a fixed pattern.
EXTENSION_ERROR = r"(?:Error|Exception|FAILED|error\[E\d+\]):\s*(.{10,120})"


def from_extension(calls: DataFrame, home: str = "/root") -> DataFrame:
    """Of calls as schema.TOOL_CALL, from an extension that names tools in any case: the tool, a shell's command as one
    more, the files, and an error in the result. Contexts say what was done to a file."""
    tool, given, output = F.col("tool_name"), F.col("tool_input"), F.coalesce("tool_result", F.lit(""))
    lower = F.lower(tool)
    command, one = F.coalesce(_given(given, "command"), F.lit("")), _given(given, "file_path", "path", "notebook_path")
    pattern = _given(given, "pattern", "query")
    searched = lower.isin("grep", "glob")
    told = F.when(searched, F.coalesce(F.concat(lower, F.lit(":"), pattern), lower)).when(lower == "bash", F.concat(F.lit("bash:"), F.substring(command, 1, 60))).when(lower.isin("read", "write", "edit"), F.concat(lower, F.lit(":"), one)).otherwise(tool)
    listed = F.filter(F.transform(F.split(output, "\n"), lambda x: F.regexp_extract(F.trim(x), r"^(/[^\s:]+)", 1)), lambda p: p != "")
    mentioned = F.transform(F.regexp_extract_all(command, F.lit(r"(?:^|\s)((?:/|~/)[^\s;|&><'\"]+)"), 1), lambda p: F.trim(p))
    found = F.when(searched, F.array_distinct(listed)).when(lower == "bash", mentioned).otherwise(F.array_compact(F.array(one)))
    files = F.filter(F.transform(F.filter(found, S.is_absolute), lambda p: S.resolved(p, home)), lambda p: ~S.is_skipped(p))
    error = F.regexp_extract(output, EXTENSION_ERROR, 1)
    for was, now in ((r"(?i)0x[0-9a-f]+", "0x..."), (r"\d{10,}", "..."), (r":\d+:\d+", ":N:N")):
        error = F.regexp_replace(error, was, now)
    event = lambda kind, path, context: F.struct(F.lit(kind).alias("type"), path.alias("path"), context.alias("context"))
    shell = F.when((lower == "bash") & (command != ""), F.array(event("tool", F.concat(F.lit("bash:"), F.substring(command, 1, 60)), F.concat(F.lit("bash:"), F.substring(command, 1, 80))))).otherwise(F.array().cast("array<struct<type: string, path: string, context: string>>"))
    every = F.concat(F.array(event("tool", tool, F.concat(F.lit("tool:"), tool))), shell, F.transform("_files", lambda p: event("file", p, F.col("_told"))), F.filter(F.array(event("error", F.col("_error"), tool)), lambda e: e["path"] != ""))
    named = calls.filter("tool_name is not null and tool_name <> ''").withColumns({"_files": F.coalesce(files, F.array().cast("array<string>")), "_told": told, "_error": F.substring(error, 1, 120)})
    return named.select("session_id", "at", F.posexplode(every).alias("n", "e")).select("session_id", "at", "n", "e.type", "e.path", "e.context")


def sessions_from_transcripts(lines: DataFrame) -> DataFrame:
    """(session_id, seq, file): what transcripts, lines (session_id, value) of JSON, tell of files, of sessions with two
    files at least."""
    ddl = "timestamp string, message struct<content: array<struct<type: string, name: string, input: struct<file_path: string, path: string>>>>"
    blocks = lines.select("session_id", F.from_json("value", ddl).alias("m")).select("session_id", "m.timestamp", F.posexplode("m.message.content").alias("pos", "b")).filter("b.type = 'tool_use'")
    file = F.coalesce(F.when(F.col("b.input.file_path") != "", F.col("b.input.file_path")), F.col("b.input.path"))
    used = blocks.filter(F.col("b.name").isin(*SESSION_TOOLS)).select("session_id", F.struct("timestamp", "pos").alias("seq"), file.alias("file")).filter("file <> '' and not startswith(file, '/private/tmp')")
    several = used.groupBy("session_id").agg(F.countDistinct("file").alias("n")).filter("n >= 2").select("session_id")
    return used.join(several, "session_id", "left_semi")
