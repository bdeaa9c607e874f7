"""Chat formatting by quotation linking.

Lines that begin with > are quoted, as deep as there are marks. A run of lines of one depth is a passage; passages and
their lines, of all depths, are normalised, hashed and joined, within the conversation, to the messages that first said
them. A message replies to the earlier message that most of its quoted text at the least linked depth comes from, or
else to the message before it. The messages are put in the order of the reply tree, each after what it replies to,
without the quotes that were linked: lines that only look quoted, as code or prompts do, stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, spread_join

_MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quotation, in four languages: fixed values.
_ANNOUNCED = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: Turns to a range; see running_most().
_TURNS = 1024


def normal(text: Column) -> Column:
    """Letters and digits in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _unquoted(text: Column) -> Column:
    """text without quoted lines and the lines that announce them: what a message says itself."""
    lines = F.split(text, "\n")
    return _without(text, lambda i: F.coalesce(F.get(lines, i).rlike(_MARKS), F.lit(False)))


def _without(text: Column, quoted: Callable[[Column], Column]) -> Column:
    """text without the lines that quoted(number) tells and those that announce them, trimmed of line ends."""
    stays = lambda line, i: ~(quoted(i) | (line.rlike(_ANNOUNCED) & quoted(i + 1)))
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"), r"^\s*\n|\s+$", "")


def running_most(rows: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the greatest `value` of the rows of the key before this one in the order of `at`, a number.

    A key may have any share of the rows: they are dealt to ranges of `at`, and ranges are summed up first."""
    ranged = rows.withColumn("_range", F.floor(F.col(at) / _TURNS))
    within = F.max(value).over(Window.partitionBy(key, "_range").orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    before = ranged.groupBy(key, "_range").agg(F.max(value).alias("_most"))
    before = before.select(key, "_range", F.max("_most").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return ranged.withColumn("_within", within).join(before.hint("merge"), [key, "_range"]).withColumn(name, F.greatest("_within", "_before")).drop("_range", "_within", "_before")


def _quotes(texts: DataFrame) -> DataFrame:
    """(conv_id, turn, th, depth, lines, hash, size): the passages of texts, and the lines of those of several."""
    key = ["conv_id", "turn", "th"]
    lines = texts.filter(F.col("text").rlike(r"(?m)" + _MARKS)).select(*key, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.select(*key, "line", _depth(F.col("raw")).alias("depth"), normal(F.regexp_replace("raw", _MARKS, "")).alias("said"))
    lines = lines.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy(*key, "depth").orderBy("line"))).filter("depth > 0")
    whole = lines.groupBy(*key, "depth", "run").agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("l"))
    said = F.array_join(F.filter(F.transform("l", lambda x: x["said"]), lambda x: x != ""), " ")
    whole = whole.select(*key, "depth", F.transform("l", lambda x: x["line"]).alias("lines"), said.alias("said"), F.lit(2).alias("times"))
    # The lines of a passage count beside it, so that a passage that as a whole is nowhere is linked by what of it is.
    every = whole.unionByName(lines.select(*key, "depth", F.array("line").alias("lines"), "said", F.lit(1).alias("times"))).filter("said <> ''")
    return every.select(*key, "depth", "lines", F.md5("said").alias("hash"), (F.length("said") * F.col("times")).alias("size"))


def _said(texts: DataFrame) -> DataFrame:
    """(conv_id, hash, first): what messages say themselves, as a whole, by paragraph and by line; the first turn."""
    own = texts.select("conv_id", "turn", _unquoted(F.col("text")).alias("own"))
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normal))).alias("said")).filter("said <> ''")
    return said.groupBy("conv_id", F.md5("said").alias("hash")).agg(F.min("turn").alias("first"))


def linked(texts: DataFrame) -> DataFrame:
    """(conv_id, turn, th, lines, depth, size, first): the quotations of texts (conv_id, turn, th, text) that were
    found, and the turn that first said them."""
    quotes = keep(_quotes(texts))
    talks = quotes.select("conv_id").distinct()
    said = _said(spread_join(texts, talks, ["conv_id"], [F.col("turn")], "left_semi"))
    return keep(spread_join(quotes, said, ["conv_id", "hash"], [F.col("turn"), F.col("size")], "inner").filter("first < turn").drop("hash"))


def _replies(found: DataFrame) -> DataFrame:
    """(conv_id, turn, quoted): by message with a quotation that was found, the turn it replies to."""
    votes = found.groupBy("conv_id", "turn", "depth", "first").agg(F.sum("size").alias("size"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("first", F.struct(-F.col("depth"), "size", "first")).alias("quoted"))


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, start, path): the branches of reply trees. A branch starts where a message replies to another than
    the one before it; its path sorts it into the tree: behind the rest of the branch it leaves, before the branches
    that leave that one earlier. turns: (conv_id, turn, parent, branch), branch the turn that its branch starts at."""
    starts = turns.filter("turn = branch and parent is not null").select("conv_id", F.col("turn").alias("start"), "parent")
    parents = turns.select("conv_id", F.col("turn").alias("parent"), F.col("branch").alias("leaves"))
    open_ = keep(starts.join(parents, ["conv_id", "parent"]).select("conv_id", "start", "leaves", F.array(F.struct((-F.col("parent")).alias("place"), F.col("start").alias("at"))).alias("path")))
    # Each round doubles how many branches up a path reaches.
    while open_.filter("leaves is not null").limit(1).count():
        up = open_.select("conv_id", F.col("start").alias("leaves"), F.col("leaves").alias("next"), F.col("path").alias("before"))
        open_ = keep(open_.join(up, ["conv_id", "leaves"], "left").select("conv_id", "start", F.col("next").alias("leaves"), F.concat(F.coalesce("before", F.array().cast(open_.schema["path"].dataType)), "path").alias("path")))
    return open_.select("conv_id", F.col("start").alias("branch"), "path")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, quotes, text, path), sorted by conversation, path and turn: the order of the
    reply tree. One row for every row of conversations (conv_id, turn, role, text, ...).

    reply_to: the turn it replies to, null for the first; quotes: whether a quotation tells so; text: without the quotes
    that were linked (null stays null, and a text without such quotes as it is); path: the branches to it, each with
    minus the turn it leaves at and the turn it starts at. Rows that share conversation and turn are one message in
    several pieces: links take them together. Rows without conversation or turn are passed on, unlinked; repeated rows
    stay. A text of any length is split into lines in its task. Other columns are ignored, whatever their names; an
    empty table gives an empty result."""
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    placed = rows.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "th", "text").distinct()
    found = linked(placed.filter("text is not null"))
    turns = running_most(placed.select("conv_id", "turn").distinct(), "conv_id", "turn", "turn", "previous")
    turns = turns.join(_replies(found).hint("merge"), ["conv_id", "turn"], "left").withColumn("parent", F.coalesce("quoted", "previous"))
    turns = turns.withColumn("starts", F.when(F.col("previous").isNull() | (F.col("parent") != F.col("previous")), F.col("turn")))
    turns = running_most(turns, "conv_id", "turn", "starts", "running").withColumn("branch", F.coalesce("starts", "running"))
    turns = keep(turns.select("conv_id", "turn", "parent", F.col("quoted").isNotNull().alias("quotes"), "branch"))
    ordered = turns.join(_paths(turns).hint("merge"), ["conv_id", "branch"], "left").select("conv_id", "turn", F.col("parent").alias("reply_to"), "quotes", "path")
    gone = found.select("conv_id", "turn", "th", F.explode("lines").alias("line")).groupBy("conv_id", "turn", "th").agg(F.collect_set("line").alias("gone"))
    out = spread_join(rows, ordered, ["conv_id", "turn"], [F.col("th")])
    out = spread_join(out, gone, ["conv_id", "turn", "th"], [F.col("role")])
    path = F.coalesce("path", F.array().cast(ordered.schema["path"].dataType))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), lambda i: F.array_contains("gone", i)))
    out = out.select("conv_id", "turn", "role", "reply_to", F.coalesce("quotes", F.lit(False)).alias("quotes"), text.alias("text"), path.alias("path"))
    return out.orderBy("conv_id", "path", "turn")
