"""Mining of patterns: what occurs together in sessions, in time, in order, in commits and in names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import kept
from .sequences import neighbours


#: Slots that the members of a session or a stretch of time are dealt to.
SLOTS = 4


def session_pairs(log: DataFrame, since: str | None = None, least: int = 3) -> DataFrame:
    """(n1, n2, sessions): vertices that occur in `least` sessions or more together; since: of which one was recent."""
    seen = log.groupBy("session_id", "vertex").agg(F.max("at").alias("at"))
    left = seen if since is None else seen.filter(F.col("at") > F.lit(since).cast("timestamp_ntz"))
    a, b = left.select("session_id", F.col("vertex").alias("n1")), seen.select("session_id", F.col("vertex").alias("n2"))
    # A session may have a large share of all: one side is dealt to slots, the other repeated in each.
    a, b = a.withColumn("slot", F.pmod(F.xxhash64("n1"), F.lit(SLOTS)).cast("int")), b.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return a.join(b, ["session_id", "slot"]).filter("n1 < n2").groupBy("n1", "n2").agg(F.count("*").alias("sessions")).filter(F.col("sessions") >= least)


def close_pairs(log: DataFrame, seconds: int = 60, since: str | None = None, least: int = 3) -> DataFrame:
    """(n1, n2, n, total_us, avg_seconds): vertices accessed within `seconds` of one another, `least` times or more.

    A band join: one side goes to its bucket of time and the two beside it, then the buckets are equal."""
    timed = log.select("vertex", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    a = timed if since is None else timed.filter(F.col("at") > F.lit(since).cast("timestamp_ntz"))
    width = seconds * 1_000_000
    bucket = F.floor(F.col("us") / width)
    a = a.select(F.col("vertex").alias("n1"), F.col("us").alias("us1"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = timed.select(F.col("vertex").alias("n2"), F.col("us").alias("us2"), bucket.alias("bucket"))
    apart = F.abs(F.col("us1") - F.col("us2"))
    # So may a stretch of time.
    a, b = a.withColumn("slot", F.pmod(F.xxhash64("n1", "us1"), F.lit(SLOTS)).cast("int")), b.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    near = a.join(b, ["bucket", "slot"]).filter((F.col("n1") < F.col("n2")) & (apart < width))
    sums = near.groupBy("n1", "n2").agg(F.count("*").alias("n"), F.sum(apart).alias("total_us")).filter(F.col("n") >= least)
    return sums.withColumn("avg_seconds", F.col("total_us") / F.col("n") / 1e6)


def ordered_pairs(log: DataFrame, within: int = 5, since: str | None = None, least: int = 5) -> DataFrame:
    """(first_id, second_id, n): vertices accessed at most `within` accesses after one another. No join: each access
    looks ahead in its session, of which a task has a range and the few rows after it."""
    ahead = {f"_{k}": ("vertex", k) for k in range(1, within + 1)}
    left = neighbours(log.select("session_id", "vertex", "at", "id"), "session_id", ["at", "id"], ahead)
    left = left if since is None else left.filter(F.col("at") > F.lit(since).cast("timestamp_ntz"))
    each = left.select(F.col("vertex").alias("first_id"), F.explode(F.array(*ahead)).alias("second_id")).filter("second_id is not null and first_id <> second_id")
    return each.groupBy("first_id", "second_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def directional(pairs: DataFrame) -> DataFrame:
    """Those of ordered_pairs() that go one way more than twice as often as the other."""
    back = pairs.select(F.col("first_id").alias("second_id"), F.col("second_id").alias("first_id"), F.col("n").alias("back"))
    return pairs.join(back, ["first_id", "second_id"], "left").withColumn("back", F.coalesce("back", F.lit(0))).filter(F.col("n") > 2 * F.col("back"))


def by_degree(pairs: DataFrame) -> DataFrame:
    """(u, v) of pairs (n1 < n2): each from the end of fewer pairs to that of more, the lesser of equals first. No vertex
    leads on to more than the root of twice the number of pairs."""
    degrees = pairs.select(F.explode(F.array("n1", "n2")).alias("end")).groupBy("end").agg(F.count("*").alias("d"))
    d1, d2 = (degrees.select(F.col("end").alias(f"n{k}"), F.col("d").alias(f"d{k}")) for k in (1, 2))
    up = F.struct("d1", "n1") < F.struct("d2", "n2")
    return pairs.join(d1, "n1").join(d2, "n2").select(F.when(up, F.col("n1")).otherwise(F.col("n2")).alias("u"), F.when(up, F.col("n2")).otherwise(F.col("n1")).alias("v"))


def wedges(up: DataFrame) -> DataFrame:
    """(u, v, w), v < w: what each u of (u, v) leads on to, by twos."""
    return up.join(up.select("u", F.col("v").alias("w")), "u").filter("v < w")


def triangles(pairs: DataFrame, neighbours: int | None = None) -> DataFrame:
    """(a, b, c), a < b < c, of which all three pairs (n1 < n2) exist, each pair once. neighbours: the cap on what each
    leads on to by name; else wedges are formed where they are fewest, at the end of fewest pairs."""
    if neighbours is None:
        found = wedges(kept(by_degree(pairs))).join(pairs.select(F.col("n1").alias("v"), F.col("n2").alias("w")), ["v", "w"], "left_semi")
        ends = F.array_sort(F.array("u", "v", "w"))
        return found.select(*(F.get(ends, k).alias(c) for k, c in enumerate("abc")))
    up = pairs.select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    up = up.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("k") <= neighbours).drop("k")
    on = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return up.join(on, "b").join(pairs.select(F.col("n1").alias("a"), F.col("n2").alias("c")), ["a", "c"], "left_semi").select("a", "b", "c")


def cochanges(commits: DataFrame, most_files: int = 20) -> DataFrame:
    """(f1, f2, n, contexts): pairs of files of commits (commit, file, message) of 2 to most_files files without noise,
    how often, and the first ten of the messages. Files that bulk mining skips don't count for a commit's size."""
    told = commits.filter(~F.lower("message").contains("merge") & ~S.is_skipped_in_bulk(F.col("file")))
    sized = told.groupBy("commit").agg(F.count("*").alias("files")).filter(f"files between 2 and {most_files}")
    kept = told.join(sized.select("commit"), "commit", "left_semi")
    a, b = kept.select("commit", F.col("file").alias("f1"), F.substring("message", 1, 100).alias("message")), kept.select("commit", F.col("file").alias("f2"))
    told = a.join(b, "commit").filter("f1 < f2").groupBy("f1", "f2", "message").agg(F.count("*").alias("n"))
    # Of a pair's messages ten are gathered, however many it has.
    ranked = told.withColumn("k", F.row_number().over(Window.partitionBy("f1", "f2").orderBy("message")))
    return ranked.groupBy("f1", "f2").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("message")))).alias("contexts"))


def cochange_seeds(pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, weight, n): seeds with weights by how often the pair is changed, of the most."""
    most = pairs.agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most)).select(F.concat(F.lit("file:"), F.col("f1")).alias("source_id"), F.concat(F.lit("file:"), F.col("f2")).alias("target_id"), S.cochange_weight(F.col("n"), F.col("most")).alias("weight"), "n")


def name_groups(files: DataFrame, most: int = 8) -> DataFrame:
    """(f1, f2): pairs of files (file) whose names are of one group of 2 to `most`."""
    keyed = files.distinct().withColumn("key", S.group_key(F.col("file")))
    sized = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(f"n between 2 and {most}").select("key")
    kept = keyed.join(sized, "key", "left_semi")
    return kept.select("key", F.col("file").alias("f1")).join(kept.select("key", F.col("file").alias("f2")), "key").filter("f1 < f2").select("f1", "f2")


def indexed_commits(commits: DataFrame) -> DataFrame:
    """(id, contexts): commits of 2 to 20 files and a message of 5 characters or more, no merge, as vertices whose
    contexts are the message and the files."""
    told = commits.filter((F.length("message") >= 5) & ~F.col("message").rlike(r"(?i)^merge\b")).distinct()
    sized = told.groupBy("commit", "message").agg(F.count("file").alias("n")).filter("n between 2 and 20").drop("n")
    kept = told.join(sized, ["commit", "message"], "left_semi").groupBy("commit", "message").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return kept.select(F.concat(F.lit("semantic:commit:"), F.col("commit").cast("string")).alias("id"), F.array("message", F.concat(F.lit("files:"), F.array_join("files", ","))).alias("contexts"))


def session_file_pairs(sessions: DataFrame, most: int = 20) -> DataFrame:
    """(f1, f2): pairs of the first `most` distinct files of each session (session_id, seq, file)."""
    first = sessions.groupBy("session_id", "file").agg(F.min("seq").alias("seq"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "file"))).filter(F.col("k") <= most)
    a, b = kept.select("session_id", F.col("file").alias("f1")), kept.select("session_id", F.col("file").alias("f2"))
    return a.join(b, "session_id").filter("f1 < f2").select("f1", "f2").distinct()


def structural_seeds(links: DataFrame, imports: DataFrame, names: DataFrame, sessions: DataFrame) -> DataFrame:
    """(source_id, target_id, weight, n): seeds of links and imports (source, target), and of pairs of files (f1, f2) with
    names of one group or of one session; explicit ties are stronger than inferred ones."""
    parts = [(links, "source", "target", 0.6), (imports, "source", "target", 0.5), (names, "f1", "f2", 0.3), (sessions, "f1", "f2", 0.4)]
    every = None
    for rows, a, b, weight in parts:
        part = rows.select(F.concat(F.lit("file:"), F.col(a)).alias("source_id"), F.concat(F.lit("file:"), F.col(b)).alias("target_id"), F.lit(weight).alias("weight"), F.lit(1).alias("n"))
        every = part if every is None else every.unionByName(part)
    return every.filter("source_id <> target_id")
