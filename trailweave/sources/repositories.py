"""Graphs out of repositories and notes: change logs, imports, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_IMPORT = r"(?:import\s+.*?\s+from\s+['\"](.+?)['\"]|require\s*\(\s*['\"](.+?)['\"]\s*\))"
#: What a name in an import may stand for, in order: fixed values.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", "", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def parsed_log(lines: DataFrame, most_files: int = 20) -> DataFrame:
    """(log, hash, timestamp, message, files): commits of change logs, lines (log, line, value) with COMMIT:, DATE: and
    MSG: marks and else the changed files. Merges, and commits of no file or of more than most_files, are left out.

    No more than most_files + 1 files of a commit are gathered."""
    marked = lines.withColumn("n", F.sum(F.startswith("value", F.lit("COMMIT:")).cast("int")).over(Window.partitionBy("log").orderBy("line"))).filter("n > 0")
    told = lambda mark: F.max(F.when(F.startswith("value", F.lit(mark)), F.substr("value", F.lit(len(mark) + 1))))
    path = F.trim("value")
    is_file = ~F.col("value").rlike("^(COMMIT|DATE|MSG):") & (path != "") & ~S.is_skipped_in_bulk(path)
    k = F.row_number().over(Window.partitionBy("log", "n").orderBy(F.desc(is_file), "line"))
    listed = F.collect_list(F.when(is_file & (F.col("k") <= most_files + 1), F.struct("line", path.alias("p"))))
    commits = marked.withColumn("k", k).groupBy("log", "n").agg(told("COMMIT:").alias("hash"), told("DATE:").cast("bigint").alias("timestamp"), told("MSG:").alias("message"), F.transform(F.array_sort(listed), lambda x: x["p"]).alias("files"))
    return commits.filter(F.size("files").between(1, most_files) & ~F.lower(F.coalesce("message", F.lit(""))).contains("merge")).drop("n")


def logged_commits(spark: SparkSession, path: str, most_files: int = 20) -> DataFrame:
    """(log, hash, timestamp, message, files): what parsed_log() gives, of change logs at path, a file each.

    A commit is a record that ends where the next one's mark begins, so Spark reads a log in ranges, and a range owns
    the commits whose marks begin in it: no task sees a whole log. What stands before a log's first mark is left out,
    as its first word line is no hash."""
    records = spark.read.option("lineSep", "\nCOMMIT:").text(path).select(F.col("_metadata.file_path").alias("log"), F.split(F.regexp_replace("value", "^COMMIT:", ""), "\n").alias("lines"))
    told = lambda mark: F.substr(F.get(F.filter("lines", lambda x: F.startswith(x, F.lit(mark))), 0), F.lit(len(mark) + 1))
    paths = F.transform(F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: ~x.rlike("^(DATE|MSG):")), lambda x: F.trim(x))
    # One more than may be is enough to tell that there are too many.
    files = F.slice(F.filter(paths, lambda p: (p != "") & ~S.is_skipped_in_bulk(p)), 1, most_files + 1)
    commits = records.select("log", F.get("lines", 0).alias("hash"), told("DATE:").cast("bigint").alias("timestamp"), told("MSG:").alias("message"), files.alias("files"))
    merge = F.lower(F.coalesce("message", F.lit(""))).contains("merge")
    return commits.filter(F.col("hash").rlike(r"^[0-9A-Za-z._-]+$") & F.size("files").between(1, most_files) & ~merge)


def imports(files: DataFrame) -> DataFrame:
    """(file, target): relative imports in the text of files (file, text)."""
    each = files.select("file", F.explode(F.concat(F.regexp_extract_all("text", F.lit(_IMPORT), 1), F.regexp_extract_all("text", F.lit(_IMPORT), 2))).alias("target"))
    return each.filter(F.col("target").rlike("^[./]")).distinct()


def normal_path(path: Column) -> Column:
    """A path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file, target): imports() with each target the file (file) that it stands for; an equi-join of candidates."""
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    base = F.when(F.startswith("target", F.lit("/")), normal_path(F.col("target"))).otherwise(normal_path(F.concat(folder, "target")))
    stems = found.withColumn("base", base)
    plain = [F.struct(F.lit(k).alias("k"), F.concat("base", F.lit(e)).alias("candidate")) for k, e in enumerate(ENDINGS[:5])]
    renamed = [F.struct(F.lit(5 + k).alias("k"), F.when(F.endswith("target", F.lit(".js")), F.concat(F.regexp_replace("base", r"\.js$", ""), F.lit(e))).alias("candidate")) for k, e in enumerate((".ts", ".tsx"))]
    index = [F.struct(F.lit(7 + k).alias("k"), F.concat("base", F.lit(e)).alias("candidate")) for k, e in enumerate(ENDINGS[5:])]
    each = stems.select("file", "target", F.inline(F.array(*plain, *renamed, *index)))
    there = files.select(F.col("file").alias("candidate")).distinct()
    return each.join(there, "candidate").groupBy("file", "target").agg(F.min_by("candidate", "k").alias("target_file")).select("file", F.col("target_file").alias("target"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target): links of pages (source, html)."""
    return pages.select("source", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("target")).distinct()


def noted_links(notes: DataFrame) -> DataFrame:
    """(source, target): of JSON (value) that maps notes to the notes they link to."""
    each = notes.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("source", "targets"))
    return each.select("source", F.explode("targets").alias("target"))


def listed_files(spark, root: str, pattern: str = "*") -> DataFrame:
    """(file, text) of the files under a root, without those that bulk mining skips."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.filter(~S.is_skipped_in_bulk(F.col("path"))).select(path.alias("file"), F.decode("content", "UTF-8").alias("text"))
