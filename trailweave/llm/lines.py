"""Line dedup by winnowing over line hashes.

A text is a sequence of short lines: its lines, cut after the marks . ! ? ; : too, so that a passage that begins or
ends inside a line has whole short lines all the same. Each is known by the hash of its words. From each on, as many
short lines as have eight words are a gram. Of two grams in a row the least hash is a fingerprint, as is any gram that
begins with a short line of 23 words or more: a run of short lines with 30 words or more has one at its first line or
the second, and the same wherever it stands. Fingerprints that repeat are joined back to their positions, and only
from these positions matches are extended, to both ends: to the runs of short lines with the fingerprint that have
`min_words` words, but fewer without the last or without the first. Runs that are equal are joined to the first of
them; later ones go. Longer matches are covered by such runs. Texts that repeat as a whole are found by their hash
before: later copies go whole, and all else works on the first of them. Each step works on one text's arrays, or is a
grouped minimum or an equi-join: pairs of occurrences are never formed."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACES, SPACE_CLASS, fresh, keep, member_bits, settled, split_by_bits, spread_join

MIN_WORDS = 30
#: Words of a gram, and words from which a short line's gram is taken in any case. With these a run of GRAM + LONG - 1 =
#: 30 words begins with two whole grams in a row, or with a long line.
GRAM, LONG = 8, 23
#: With so many fingerprints that repeat, bits leave too little out: then they are joined to their positions by rows.
CROWDED = PLACES // 2
_MARKS = ".!?;:"
#: Where a text is cut: behind a line end, and behind a mark and the white space after it.
_CUT = rf"(?<=\n)|(?<=[{_MARKS}]{SPACE_CLASS})"


def _has(text: Column, parts: str | list[str]) -> Column:
    """Whether the text has any of the parts: plain search, which is faster than a pattern."""
    return reduce(or_, (F.contains(text, F.lit(part)) for part in parts))


def _marked(text: Column, ends: dict[str, str]) -> Column:
    """The text with each of the ends replaced, those that it has."""
    pairs = F.array(*(F.struct(F.lit(end).alias("end"), F.lit(to).alias("to")) for end, to in ends.items()))
    return F.aggregate(pairs, text, lambda t, e: F.when(F.contains(t, e["end"]), F.replace(t, e["end"], e["to"])).otherwise(t))


def _pieces(text: Column) -> Column:
    plain = F.split(_marked(text, {end: f"{end}\1" for end in ("\n", *(f"{m} " for m in _MARKS))}), "\1")
    return F.when(_has(text, "\t\x0B\f\r\1"), F.split(text, _CUT)).otherwise(plain)


def _worded(text: Column) -> Column:
    """(i, h, n) of each short line with words: its place among all, the hash of its words and their number. The cuts
    are those of _pieces(), found in the text with single spaces."""
    plain = F.when(_has(text, [*"\t\x0B\f\r", "  "]), F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)
    marked = F.split(_marked(plain, {"\n": "\1", **{f"{m} ": f"{m}\1" for m in _MARKS}}), "\1")
    cut = F.when(_has(text, "\1"), F.split(plain, rf"\n|(?<=[{_MARKS}]) ")).otherwise(marked)
    words = F.transform(cut, lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("w")))
    count = lambda w: F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.filter(words, lambda x: x["w"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["w"]).alias("h"), count(x["w"]).alias("n")))


def known_texts(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, th2, row, units, places, words): the texts with enough words, known by doc_id and the text's hash th, and the
    hashes, places and numbers of words of their short lines. The key is one struct, by which null numbers are joined and
    grouped as any other; th2 makes 128 bits of the hash; row numbers the rows, those that repeat too."""
    some = docs.filter(F.col("text").isNotNull()).select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"), F.xxhash64(F.lit(1), "text").alias("th2"), F.monotonically_increasing_id().alias("row"), "text")
    made = settled(some, u=_worded(F.col("text"))).select("key", "th2", "row", *(F.col(f"u.{c}").alias(n) for c, n in (("h", "units"), ("i", "places"), ("n", "words"))))
    return made.filter(F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + w) >= min_words)


def _place(*more: str) -> Column:
    return F.struct(F.col("key.doc_id").isNull().alias("null_id"), "key.doc_id", "key.th", *more)


def later_rows(texts: DataFrame) -> DataFrame:
    """(row, key, copy): the rows of which another of a smaller place has the same text, or a smaller row the same text
    under the same number (copy is false)."""
    thin = texts.select("row", "key", "th2", F.col("key.th").alias("th"))
    first = thin.groupBy("th", "th2").agg(F.min(_place("row")).alias("first"), F.max(_place("row")).alias("last")).filter("first < last").drop("last")
    later = spread_join(thin, first, ["th", "th2"], [F.col("row")], "inner").filter(_place("row") > F.col("first"))
    return later.select("row", "key", (_place() > F.struct("first.null_id", "first.doc_id", "first.th")).alias("copy"))


def _by_line(texts: DataFrame) -> DataFrame:
    """A row for each short line: x its number, w the number of words before it, and its text's columns with `line_of`, by
    which the line of each word is found. Arrays aren't copied: all that follows up to a shuffle is one loop."""
    line_of = F.flatten(F.transform("words", lambda n, x: F.array_repeat(x, n)))
    every = settled(texts, line_of=line_of).select("*", F.posexplode("line_of").alias("w", "x"))
    return every.filter((F.col("w") == 0) | (F.get("line_of", F.col("w") - 1) != F.col("x")))


def _gram(x: Column, w: Column) -> Column:
    """The hash of the gram that begins with line x, which has w words before it; null where the text has no such gram."""
    last = F.get("line_of", w + (GRAM - 1))
    return F.when((x >= 0) & last.isNotNull(), F.xxhash64(F.slice("units", x + 1, last - x + 1)))


def fingerprints(texts: DataFrame) -> DataFrame:
    """(fp, key, x): the selected fingerprints and where they are, x the number of the short line with words."""
    x, w = F.col("x"), F.col("w")
    own, before = F.get("words", x), F.get("words", x - 1)
    lines = _by_line(texts.select("key", "units", "words"))
    placed = settled(lines, g=_gram(x, w), g_before=F.when(x > 0, _gram(x - 1, w - before)), g_behind=_gram(x + 1, w + own))
    least = (F.col("g") <= F.col("g_before")) | (F.col("g") <= F.col("g_behind"))
    return placed.filter(F.col("g").isNotNull() & ((own >= LONG) | F.coalesce(least, F.lit(False)))).select(F.col("g").alias("fp"), "key", "x")


def _starts(texts: DataFrame, min_words: int) -> DataFrame:
    """The lines with which runs begin: the shortest run's last line `upto`, the fingerprint fp of all runs from there,
    the line at that it stands, and the text's columns."""
    x, w, own = F.col("x"), F.col("w"), F.get("words", F.col("x"))
    whole = _by_line(texts).withColumn("upto", F.get("line_of", w + (min_words - 1))).filter("upto is not null")
    placed = settled(whole, g=_gram(x, w), g_behind=F.when(own < LONG, _gram(x + 1, w + own)), behind=F.get("line_of", w + own + (min_words - 1)))
    own_least = F.coalesce(F.col("g") <= F.col("g_behind"), F.lit(True))
    return placed.withColumn("fp", F.when(own_least, F.col("g")).otherwise(F.col("g_behind"))).withColumn("at", F.when(own_least, x).otherwise(x + 1))


def _extended(starts: DataFrame) -> DataFrame:
    """(key, line, last, p1, p2): the runs that begin at these lines, with 128 bits of their words. Beside the shortest
    there are those that would be too short without their first line."""
    end = F.greatest(F.col("upto"), F.coalesce(F.col("behind"), F.size("units")) - 1)
    each = starts.select("key", "x", "units", "places", F.explode(F.sequence("upto", end)).alias("y"))
    each = settled(each, hs=F.slice("units", F.col("x") + 1, F.col("y") - F.col("x") + 1))
    return each.select("key", F.get("places", F.col("x")).alias("line"), F.get("places", F.col("y")).alias("last"), F.xxhash64("hs").alias("p1"), F.xxhash64(F.lit(1), "hs").alias("p2"))


def passages(texts: DataFrame, at: DataFrame, min_words: int) -> DataFrame:
    """(key, line, last, p1, p2): the runs whose fingerprints are at the positions (key, xs)."""
    # A flag for each short line up to the last that is hit, so that no line is looked for among the positions.
    at = settled(at, xs=F.sort_array("xs"))
    gap = lambda x, k: F.array_repeat(F.lit(False), x - F.coalesce(F.get("xs", k - 1), F.lit(-1)) - 1)
    at = at.select("key", F.flatten(F.transform("xs", lambda x, k: F.concat(gap(x, k), F.array(F.lit(True))))).alias("hits"))
    near = texts.select("key", "units", "places", "words").join(at.hint("merge"), "key")
    return _extended(_starts(near, min_words).filter(F.get("hits", F.col("at"))))


def repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, copy, gone): by text that repeats another as a whole (copy), or passages: for its short lines whether each
    goes."""
    texts = keep(known_texts(docs, min_words))
    later = keep(later_rows(texts))
    found = fingerprints(texts)
    # Copies of a text don't make its fingerprints repeat: it has them at the same places.
    where = F.xxhash64("key.th", "x")
    again = keep(found.groupBy("fp").agg(F.min(where).alias("low"), F.max(where).alias("high")).filter("low <> high").select("fp"))
    may, firsts = split_by_bits(texts, member_bits(later, F.col("row")), F.col("row"))
    firsts = firsts.unionByName(may.join(later.select("row").hint("merge"), "row", "left_anti"))
    if again.count() <= CROWDED:
        # A run that repeats has a fingerprint that does; one that the bits let through beside these meets no equal run.
        near, _ = split_by_bits(_starts(firsts.select("key", "units", "places", "words"), min_words), member_bits(again, F.col("fp")), F.col("fp"))
        extended = keep(_extended(near))
    else:
        at = spread_join(found, again, ["fp"], [F.col("key"), F.col("x")], "left_semi", salts=4).groupBy("key").agg(F.collect_set("x").alias("xs"))
        extended = keep(passages(firsts, at, min_words))
    first = extended.groupBy("p1", "p2").agg(F.min(_place("line")).alias("begin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again_there = spread_join(extended, first, ["p1", "p2"], [F.col("key"), F.col("line")], "inner", salts=4).filter(_place("line") > F.col("begin"))
    # Each run adds the lines beyond those before it.
    upto = F.coalesce(F.max("last").over(Window.partitionBy("key").orderBy("line", "last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = again_there.select("key", "line", "last", upto.alias("upto")).filter("last > upto")
    start = F.greatest(F.col("line"), F.col("upto") + 1)
    runs = runs.select("key", F.struct(start.alias("start"), (start - F.col("upto") - 1).alias("stay"), (F.col("last") - start + 1).alias("go")).alias("r"))
    flags = F.flatten(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.concat(F.array_repeat(F.lit(False), r["stay"]), F.array_repeat(F.lit(True), r["go"]))))
    gone = runs.groupBy("key").agg(flags.alias("gone")).select("key", F.lit(False).alias("copy"), "gone")
    copies = later.filter("copy").select("key", "copy").distinct()
    return gone.unionByName(copies.withColumn("gone", F.lit(None).cast("array<boolean>")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, without later repeats of runs of short lines with `min_words` words or more (30 at least), and with a
    column _deleted_lines, how many short lines of the text went (in place of any column of that name).

    Short lines are equal if their words are. Repeats within a text count too. Lines without words stay unless they
    are within a run. The first occurrence is the one of the smallest doc_id (nulls last), then by line; of different
    texts under one doc_id, by their hash. Rows that repeat both doc_id and text are one text and get the same
    result. Null texts stay null, empty and short ones as they are; a text of any length is one row of hashes, a fifth
    of its size. n_chars, if there is one, is counted anew where lines went. An empty table gives an empty result;
    columns other than these pass through, whatever their names."""
    columns = docs.columns
    key, mark, deleted = fresh(columns, "_k"), fresh(columns, "_mark"), "_deleted_lines"
    if min_words < GRAM + LONG - 1:
        raise ValueError(f"runs of fewer than {GRAM + LONG - 1} words may have no fingerprint")
    typed = docs.withColumn("text", F.col("text").cast("string"))
    marks = keep(repeats(typed.select("doc_id", "text"), min_words).select(F.col("key").alias(key), F.struct("copy", "gone").alias(mark)))
    # The key as one struct joins nulls too. Marks grow with the texts: they are joined one way at every size. Texts that
    # can't have a mark stay where they are.
    keyed = typed.drop(deleted).withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("th")))
    may, stay = split_by_bits(keyed, member_bits(marks, F.col(key)), F.col(key))
    out = may.join(marks.hint("merge"), key, "left")
    out = settled(out, **{mark: F.when(F.col(mark).isNotNull(), F.struct(f"{mark}.*", _pieces(F.col("text")).alias("pieces")))})
    # A later copy goes from its first line with words to its last.
    said = F.transform(f"{mark}.pieces", lambda p: p.rlike(r"[^\x20\x09-\x0D]"))
    begin, end = F.array_position(said, True) - 1, F.size(said) - F.array_position(F.reverse(said), True)
    whole = F.concat(F.array_repeat(F.lit(False), begin.cast("int")), F.array_repeat(F.lit(True), (end - begin + 1).cast("int")))
    out = settled(out, **{mark: F.when(F.col(mark).isNotNull(), F.struct(F.col(f"{mark}.pieces").alias("pieces"), F.when(F.col(f"{mark}.copy"), whole).otherwise(F.col(f"{mark}.gone")).alias("gone")))})
    left = F.filter(f"{mark}.pieces", lambda p, i: ~F.coalesce(F.get(f"{mark}.gone", i), F.lit(False)))
    out = out.withColumn(deleted, F.coalesce(F.aggregate(f"{mark}.gone", F.lit(0), lambda n, x: n + x.cast("int")), F.lit(0)))
    touched = F.col(mark).isNotNull()
    out = out.withColumn("text", F.when(touched, F.array_join(left, "")).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    names = [c for c in columns if c != deleted]
    return out.select(*names, deleted).unionByName(stay.select(*names, F.lit(0).alias(deleted)))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_deleted_lines, text): every row of docs as dedup_lines() leaves it."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", F.col("_deleted_lines").cast("bigint").alias("n_deleted_lines"), "text")


#: The same by comparing the words of all passages, for DuckDB.
ORACLE = rf"""
with raw as (
  select doc_id, unnest(p) as raw, generate_subscripts(p, 1) as line
  from (select doc_id, string_split(regexp_replace(text, '(\n|[.!?;:][\x20\x09-\x0D])', '\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null)),
lines as (
  select doc_id, line, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) as words from raw),
worded as (
  select *, len(string_split(words, ' ')) as n from lines where words <> ''),
placed as (
  select *, sum(n) over (partition by doc_id order by line) - n as pos from worded),
grown as (
  select doc_id, line, string_agg(words, chr(10)) over w as passage, max(line) over w as last, max(pos + n) over w - pos as size
  from placed window w as (partition by doc_id order by pos range between current row and {MIN_WORDS - 1} following)
  union
  select doc_id, min(line) over w, string_agg(words, chr(10)) over w, line, pos + n - min(pos) over w
  from placed window w as (partition by doc_id order by pos + n range between {MIN_WORDS - 1} preceding and current row)),
counted as (
  select *, row_number() over (partition by passage order by doc_id, line) as k from grown where size >= {MIN_WORDS}),
gone as (
  select distinct l.doc_id, l.line from lines l join counted c on c.doc_id = l.doc_id and c.k > 1 and l.line between c.line and c.last)
select d.doc_id, coalesce(x.n, 0)::bigint as n_deleted_lines,
  case when d.text is null then null when x.n is null then d.text else coalesce(x.kept, '') end as text
from documents d left join (
  select l.doc_id, count(g.line) as n, string_agg(case when g.line is null then l.raw end, '' order by l.line) as kept
  from lines l left join gone g on g.doc_id = l.doc_id and g.line = l.line group by 1 having count(g.line) > 0) x
on x.doc_id = d.doc_id
"""
