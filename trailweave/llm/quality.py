"""Quality rules: text statistics, fixed rules on them, and robust multivariate outliers.

The statistics of a text are one vector; per language and source a minimum-covariance-determinant estimate gives its
centre and spread, and texts too far from the centre by Mahalanobis distance are rejected. The estimate is found as
in the fast algorithm of Rousseeuw and Van Driessen: many starts of a few random rows take two concentration steps
within a small random subset of their group; the best two, and all rows as one more, take a step over all rows; and the
best of these goes on over all rows until its determinant falls no more. All groups and starts take their steps
together: distances are one join with the table of estimates, the part of the rows that a step keeps is found from a
histogram of the distances, and the new estimates are sums. What a group holds never meets in one task, except as
counts and sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, group_join, keep

#: Names of the transformed statistics, and for each the spread below which differences mean nothing: it is added
#: to the estimated spread, so that a statistic that is the same in most texts doesn't make the matrix singular.
#: Each statistic by itself can reject: x_repeats, the narrowest, beyond .63, which is 40 % of the words.
FEATURES = {"x_length": 0.05, "x_symbols": 0.06, "x_lines": 0.05, "x_repeats": 0.13}
#: 1 - 1e-4 of the chi-squared distribution with 4 degrees of freedom: a fixed value.
CUTOFF = 23.513
#: Median of the chi-squared distribution with 4 degrees of freedom: a fixed value.
CHI2_MEDIAN = 3.3567
#: Rows below which a group is estimated with its language's other small groups.
LEAST_ROWS = 50
#: Rows of the random subset of a group that starts are tried in, how many starts, and how many rows each begins with.
#: Of 24 starts of 5 rows, one has no outlier with a probability of .998 where a quarter of the rows are outliers.
SUBSET, STARTS, START_ROWS = 240, 24, 5
#: A step goes on if it lowers the determinant's root by this share, and how many steps there are at most.
LEAST_GAIN, MOST_STEPS = 1e-3, 30
#: Steps of the histogram of distances to one unit of their logarithm.
_FINE = 64


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text (null: none), all bigint."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumn("_words", F.filter(F.split("_text", f"{SPACE_CLASS}+"), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_words").cast("bigint"))
    grams = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    out = out.withColumn("_grams", F.coalesce(grams, F.array().cast("array<bigint>")))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    # Windows sorted by hash and place: those that have their hash in common are neighbours.
    placed = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_placed", placed)
    same = lambda i, j: F.coalesce(F.get("_placed", i)["h"] == F.get("_placed", j)["h"], F.lit(False))
    twice = F.filter("_placed", lambda p, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
    out = out.withColumn("_twice", F.array_sort(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.regexp_replace("_text", f"{SPACE_CLASS}+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def _transformed() -> list[Column]:
    """The vector: log mean word length, and roots of the shares of symbols, of repeated lines and repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / words).alias("x_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / words).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x_repeats"),
    ]


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in list(FEATURES)[: i + 1]]


def _moments(rows: DataFrame, key: list[str]) -> DataFrame:
    """By key: n, the mean m_a of each feature and the covariance c_a_b of each two."""
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in FEATURES), *(F.avg(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _PAIRS))
    return sums.select(*key, "n", *(f"m_{a}" for a in FEATURES), *((F.col(f"s_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")).alias(f"c_{a}_{b}") for a, b in _PAIRS))


def _factored(estimates: DataFrame, scale: Column) -> DataFrame:
    """estimates with the lower Cholesky factor l_a_b of scale times the covariance, plus the least spreads, and det,
    the determinant's root."""
    out = estimates
    for a in FEATURES:
        for b in list(FEATURES)[: list(FEATURES).index(a) + 1]:
            before = list(FEATURES)[: list(FEATURES).index(b)]
            rest = F.col(f"c_{a}_{b}") * scale - sum((F.col(f"l_{a}_{z}") * F.col(f"l_{b}_{z}") for z in before), F.lit(0.0))
            if a == b:
                out = out.withColumn(f"l_{a}_{a}", F.sqrt(F.greatest(rest + FEATURES[a] ** 2, F.lit(FEATURES[a] ** 2))))
            else:
                out = out.withColumn(f"l_{a}_{b}", rest / F.col(f"l_{b}_{b}"))
    return out.withColumn("det", reduce(lambda x, y: x * y, (F.col(f"l_{a}_{a}") for a in FEATURES)))


def _with_distance(rows: DataFrame) -> DataFrame:
    """rows, joined to factored estimates, with the squared Mahalanobis distance d2."""
    out = rows
    for i, a in enumerate(FEATURES):
        before = list(FEATURES)[:i]
        out = out.withColumn(f"z_{a}", (F.col(a) - F.col(f"m_{a}") - sum((F.col(f"l_{a}_{b}") * F.col(f"z_{b}") for b in before), F.lit(0.0))) / F.col(f"l_{a}_{a}"))
    return out.withColumn("d2", sum((F.col(f"z_{a}") ** 2 for a in FEATURES), F.lit(0.0)))


def _nearest(rows: DataFrame, key: list[str], share: float) -> DataFrame:
    """By key: cut, the histogram step of log d2 within which lie `share` of the rows, and d2 beyond that step."""
    counts = rows.groupBy(*key, "step").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*key).orderBy("step")
    upto = counts.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    cut = upto.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*key).agg(F.min("step").alias("cut"))
    return cut.withColumn("edge", F.exp((F.col("cut") + 1) / F.lit(float(_FINE))) - F.lit(1e-6))


def _step() -> Column:
    return F.floor(F.log(F.col("d2") + F.lit(1e-6)) * _FINE)


_GROUP = ["g_lang", "g_source"]
_KEY = [*_GROUP, "start"]


def _concentrated(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """The estimates by _KEY after a step: of the rows of its group, `share` of all, nearest to each."""
    by = [F.col(a) for a in FEATURES]
    each = _with_distance(group_join(rows, now.drop("n"), _GROUP, by, "inner")).withColumn("step", _step())
    near = group_join(each, _nearest(each, _KEY, share).drop("edge"), _KEY, by, "inner").filter("step <= cut").select(*_KEY, *FEATURES)
    return keep(_factored(_moments(near, _KEY), F.lit(1.0)))


def _best(now: DataFrame, n: int) -> DataFrame:
    return now.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy("det", "start"))).filter(F.col("rank") <= n).drop("rank")


def _first_guesses(rows: DataFrame, share: float) -> DataFrame:
    """The two best of the small starts, and all rows, by group."""
    by = [F.col(a) for a in FEATURES]
    sized = group_join(rows, rows.groupBy(*_GROUP).agg(F.count("*").alias("n")), _GROUP, by, "inner")
    subset = keep(sized.filter(F.pmod("h", F.lit(1 << 20)) * F.col("n") < (SUBSET << 20)))
    slots = F.greatest(F.floor(F.least("n", F.lit(SUBSET)) / START_ROWS), F.lit(1))
    starts = subset.withColumn("start", F.pmod(F.shiftright("h", 20), slots).cast("int")).filter(F.col("start") < STARTS)
    now = keep(_factored(_moments(starts, _KEY), F.lit(1.0)))
    for _ in range(2):
        now = _concentrated(subset.drop("n"), now, share)
    whole = _factored(_moments(rows.withColumn("start", F.lit(-1)), _KEY), F.lit(1.0))
    return keep(_best(now, 2).unionByName(whole))


def estimates(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """By (g_lang, g_source): the factored MCD estimate of the rows (g_lang, g_source, h, features), h a hash.

    The covariance is scaled so that the median distance is what it is for normal data."""
    best = keep(_best(_concentrated(rows, _first_guesses(rows, share), share), 1))
    for _ in range(MOST_STEPS):
        after = _concentrated(rows, best, share)
        gains = after.join(best.select(*_GROUP, F.col("det").alias("before")), _GROUP).filter(F.col("det") < F.col("before") * (1 - LEAST_GAIN)).drop("before")
        better = keep(gains)
        if better.isEmpty():
            break
        best = keep(best.join(better, _GROUP, "left_anti").unionByName(better))
    each = _with_distance(group_join(rows, best.drop("n"), _GROUP, [F.col(a) for a in FEATURES], "inner")).withColumn("step", _step())
    median = _nearest(each, _GROUP, 0.5).select(*_GROUP, F.greatest(F.col("edge") / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    plain = best.select(*_GROUP, *(f"m_{a}" for a in FEATURES), *(f"c_{a}_{b}" for a, b in _PAIRS))
    return keep(_factored(plain.join(median, _GROUP), F.col("scale")).drop("scale"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every
    row of docs (doc_id, text, lang, source, ...).

    base_failed: fewer than 50 words, or more than half of them in three-word windows that repeat. Rows that pass
    are kept unless their distance from the robust centre of their language and source is beyond the cutoff; only
    they enter the estimates. A null language or source is a group of its own. A group with fewer than `least_rows`
    such rows is estimated together with the small groups of its language; if these are too few as well, together
    with those of all languages; if even these are, nothing is rejected in it and distance is null. Null and empty
    texts have no words; texts of any length are taken whole. Repeated rows count each. Other columns are ignored,
    whatever their names; an empty table gives an empty result."""
    base = statistics(docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = lambda c: F.concat(F.lit("="), F.coalesce(F.col(c), F.lit("")), F.when(F.col(c).isNull(), "0").otherwise("1"))
    base = keep(base.select("*", failed.alias("base_failed"), *_transformed(), known("lang").alias("lang_"), known("source").alias("source_"), F.xxhash64("doc_id", "n_words", "word_chars").alias("h")).drop("lang", "source"))

    sizes = base.filter("not base_failed").groupBy("lang_", "source_").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang_")
    small = F.col("n") < least_rows
    sizes = sizes.withColumn("n_lang", F.sum(F.when(small, F.col("n"))).over(by_lang))
    groups = sizes.select(
        "lang_", "source_",
        F.when(small & (F.col("n_lang") < least_rows), "").otherwise(F.col("lang_")).alias("g_lang"),
        F.when(small, "").otherwise(F.col("source_")).alias("g_source"),
    )
    placed = group_join(base, groups, ["lang_", "source_"], [F.col("doc_id"), F.col("n_words")]).drop("lang_", "source_")
    rows = placed.filter("not base_failed").select("g_lang", "g_source", "h", *FEATURES)
    found = estimates(rows)
    enough = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows).drop("n")
    out = _with_distance(group_join(placed, found.join(enough, ["g_lang", "g_source"]), ["g_lang", "g_source"], [F.col("doc_id"), F.col("n_words")]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))
