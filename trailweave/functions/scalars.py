"""Column functions of the memory model: all JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _replaced(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def _first_match(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for p, name in patterns.items()), F.lit(otherwise))


def normalize_error(message: Column) -> Column:
    """A message without what varies between like errors."""
    return F.trim(_replaced(message, C.ERROR_NORMAL))


def error_type(message: Column) -> Column:
    return _first_match(message, C.ERROR_TYPES, "GENERIC_ERROR")


def error_operation(message: Column) -> Column:
    return _first_match(message, C.ERROR_OPERATIONS, "unknown")


def error_fingerprint(message: Column) -> Column:
    return F.concat_ws("|", error_type(message), error_operation(message))


def detect_output_error(output: Column) -> Column:
    """The first error that the last 2000 characters of an output tell, normalised; null if none."""
    tail = F.when(F.length(output) >= 10, F.when(F.length(output) > 2000, F.right(output, F.lit(2000))).otherwise(output))
    some = lambda p, group: F.nullif(F.regexp_extract(tail, p, group), F.lit(""))
    raw = F.coalesce(*(some(p, group) for p in C.OUTPUT_ERRORS for group in (1, 0)))
    return F.substring(_replaced(F.trim(raw), C.OUTPUT_NORMAL), 1, 120)


def words_of(query: Column, least: int = 3) -> Column:
    """The words of a query with `least` characters or more, in lower case."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) >= least)


def myelin_delta(m: Column, n: Column) -> Column:
    """What the n-th access adds to a myelination of m."""
    return C.MYELIN_RATE * (1 - m / C.MYELIN_MAX) * F.greatest(1 / F.sqrt(F.greatest(n, F.lit(1))), F.lit(C.MYELIN_FLOOR))


def myelination(n: Column) -> Column:
    """The myelination after n accesses without decay. From the hundredth access on each adds a fixed share."""
    share = lambda k: 1 - F.lit(C.MYELIN_RATE / C.MYELIN_MAX) * F.greatest(1 / F.sqrt(k), F.lit(C.MYELIN_FLOOR))
    early = F.when(n > 1, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(n - 1, F.lit(100).cast("bigint"))), F.lit(1.0), lambda p, k: p * share(k))).otherwise(1.0)
    late = F.pow(F.lit(1 - C.MYELIN_RATE / C.MYELIN_MAX * C.MYELIN_FLOOR), F.greatest(n - 101, F.lit(0)))
    return C.MYELIN_MAX * (1 - early * late)


def snap(w: Column) -> Column:
    """How plastic an edge of weight w still is."""
    return 1 / (1 + F.exp(C.SNAP_STEEPNESS * (w - C.SNAP_MIDPOINT)))


def saturating_add(w: Column, d: Column) -> Column:
    return F.least(w + d * (1 - w), F.lit(1.0))


def strengthen(w: Column, d: Column) -> Column:
    """An edge of weight w after an impulse d."""
    return saturating_add(w, d * snap(w))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


#: Marks of files that belong to another: fixed values.
_RELATED = r"(?i)\.(test|spec|stories|story|styles|module|mock|stub|fixture|d)\."


def group_key(path: Column) -> Column:
    """What files for one thing have in common: the stem without marks for tests, stories or types."""
    return F.lower(F.regexp_replace(F.concat_ws(".", F.split(basename(path), _RELATED, 2)), r"\.[^.]+$", ""))


def confidence(query_words: Column, contexts: Column, path: Column, myelin: Column, age_hours: Column, similarity: Column | None = None, path_weight: float = 0.4, stems: bool = True, types: bool = True) -> Column:
    """How sure it is that a vertex is meant: what its contexts have of the query is a factor, all else a bonus."""
    share = lambda where: F.when(F.size(query_words) > 0, F.size(F.filter(query_words, lambda w: F.contains(where, w))) / F.size(query_words)).otherwise(0.0)
    told = share(F.lower(F.array_join(contexts, " ")))
    context = told if similarity is None else F.coalesce(F.greatest(similarity, F.lit(0.0)), told)
    named = F.exists(query_words, lambda w: (F.length(w) >= 4) & F.contains(F.lower(stem(path)), w)) if stems else F.lit(False)
    context = F.when(named, F.greatest(context, F.lit(0.5))).otherwise(context)
    bonus = F.least(myelin, F.lit(C.MYELIN_CAP)) * 0.3 + F.greatest(F.lit(0.0), 1 - age_hours / 168) * 0.2 + share(F.lower(path)) * path_weight
    if stems:
        bonus += F.when(named, 0.4).otherwise(0.0)
    if types:
        bonus += F.when(path.rlike(C.SOURCE_CODE), 0.3).when(path.rlike(C.DOCUMENTATION), -0.15).otherwise(0.0)
    return F.least(context * (1 + bonus), F.lit(1.0))


def confidence_lite(query_words: Column, contexts: Column, path: Column, myelin: Column, age_hours: Column) -> Column:
    """The same of the reduced engine; without a word to look for, half the myelination."""
    return F.when(F.size(query_words) == 0, myelin * 0.5).otherwise(confidence(query_words, contexts, path, myelin, age_hours, path_weight=0.2, stems=False, types=False))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of vectors of unit length, within -1 and 1; 0 if their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))).otherwise(0.0)


def level(value: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(value >= high, "HIGH").when(value >= medium, "MEDIUM").otherwise("LOW")


def token_cost(kind: Column) -> Column:
    return F.when(kind == "file", C.TOKENS_FILE).otherwise(C.TOKENS_OTHER)


def projected_myelin(m: Column, days: Column) -> Column:
    return F.round(m * F.pow(F.lit(C.DECAY_MYELIN), days), 3)


def cochange_weight(n: Column, most: Column) -> Column:
    return F.least(0.05 + n / most * 0.9, F.lit(0.95))


def proximity_weight(mean_seconds: Column, within: float = 60.0) -> Column:
    return 0.15 + 0.15 * (1 - F.least(mean_seconds, F.lit(within)) / within)


def ignored_decay(streak: Column) -> Column:
    return 1 - F.pow(F.lit(1 - C.IGNORED_DECAY), streak)


def is_error(text: Column) -> Column:
    return text.rlike("(?i)error|failed|traceback|exception")


def truncated(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def payload(text: Column, most: int = 8192) -> Column:
    """A trace's payload, cut at `most` characters with a mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…[truncated]"))).otherwise(text)


def first_distinct(items: Column, most: int) -> Column:
    """The distinct items in the order in which they first came, the last `most` of them."""
    distinct = F.array_distinct(items)
    return F.slice(distinct, F.greatest(F.size(distinct) - most + 1, F.lit(1)), most)


def is_skipped(path: Column) -> Column:
    return path.rlike(C.SKIPPED_PATHS)


def is_skipped_in_bulk(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))
    return path.rlike(C.BULK_SKIPPED_PATHS) | ext.isin(C.BULK_SKIPPED_TYPES) | path.rlike(r"\.min\.(js|css)$") | basename(path).isin(C.BULK_SKIPPED_NAMES)


def is_low_signal(path: Column) -> Column:
    return basename(path).isin(C.LOW_SIGNAL)


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.startswith("~/")


def resolved(path: Column, home: str = "/root") -> Column:
    return F.when(path.startswith("~/"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)


def input_summary(json: Column) -> Column:
    """What a tool call was about: command, path, pattern, query or content."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in ("command", "path", "pattern", "query", "content")))


def input_path(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.path"), F.get_json_object(json, "$.file_path"))


def project_of(folder: Column) -> Column:
    """The project that a folder stands for: the last part of its path, null if it has none."""
    return F.try_element_at(F.filter(F.split(folder, "/"), lambda p: p != ""), F.lit(-1))
