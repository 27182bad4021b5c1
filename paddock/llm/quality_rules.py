"""Quality rules: fixed limits, then robust multivariate outliers for each language and source.

Five statistics of a text are transformed so that usual texts scatter evenly. For each language and source their centre and
covariance are estimated by minimum covariance determinant: from a robust start (medians and median deviations), concentration
steps take the nearest part of the rows, estimate anew and measure again, by which the determinant falls each time. Rows
beyond the cut of the squared Mahalanobis distance are rejected.

All in DataFrame functions. Groups are aggregated with map-side sums and mergeable quantiles, so one may hold most rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm import shared

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
#: Percent of words that may be in windows of three words found twice.
MOST_REPEATED = 50
#: Part of a group's rows from which it is estimated, and concentration steps.
NEAREST = 0.75
STEPS = 3
#: Rows that a group needs for estimates of its own.
LEAST_ROWS = 100
#: Part of usual rows that lies beyond the cut, if they scatter normally.
BEYOND = 1e-3
#: Transformed statistics, and small spreads added so that none vanishes. The last three are 0 for most rows of most groups,
#: so that the nearest rows hardly show how the others scatter: theirs is one line or word in twenty.
VECTOR = {
    "log_words": ("ln(cast(n_words AS double))", 0.01),
    "log_word_length": ("ln(word_chars / n_words)", 0.01),
    "log_symbols": ("ln(1 + 100 * n_symbols / word_chars)", 0.05),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.05),
    "repeat_words": ("n_repeat_words / n_words", 0.05),
}
NAMES = [*VECTOR]
QUANTILE_ACCURACY = 10_000


def _chi2_cdf(x: float, freedom: int) -> float:
    term = total = 1 / math.gamma(freedom / 2 + 1)
    for k in range(1, 500):
        term *= x / 2 / (freedom / 2 + k)
        total += term
    return total * (x / 2) ** (freedom / 2) * math.exp(-x / 2)


def chi2_quantile(part: float, freedom: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, freedom) < part else (low, middle)
    return (low + high) / 2


#: Makes the covariance of the nearest rows that of all, if they scatter normally.
CONSISTENCY = NEAREST / _chi2_cdf(chi2_quantile(NEAREST, len(NAMES)), len(NAMES) + 2)
CUT = chi2_quantile(1 - BEYOND, len(NAMES))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row's whole text.

    Words are runs without ASCII white space; lines count if they have a word. A null text has none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text.alias("text"))
    no_word = r"^[\x20\x09-\x0D]*$"
    rows = rows.select(
        "doc_id", "lang", "source",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: ~F.rlike(x, F.lit(no_word))).alias("lines"),
    )
    hashes = "transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))"
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(words) >= 3 THEN {hashes} END").alias("windows"),
    )
    some_twice = "size(array_distinct(windows.h)) < size(windows)"
    rows = rows.withColumn("windows", F.expr(f"CASE WHEN {some_twice} THEN array_sort(windows) END"))
    twice = "filter(windows, (x, k) -> x.h = get(windows, k - 1).h OR x.h = get(windows, k + 1).h)"
    covered = f"size(array_distinct(flatten(transform({twice}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.expr(f"CASE WHEN windows IS NOT NULL THEN {covered} END"), F.lit(0)).cast("long"))
    return rows.drop("windows")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _groups(rows: DataFrame, least_rows: int) -> DataFrame:
    """lang, source, group, for groups of enough rows: small sources of a language go together, then small languages."""
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= least_rows
    rest = counts.where(~own).groupBy("lang").agg(F.sum("n").alias("rest"))
    counts = counts.join(rest, "lang", "left")
    enough = F.col("rest") >= least_rows
    group = F.when(own, F.to_json(F.array("lang", "source"))).when(enough, F.to_json(F.array("lang"))).otherwise(F.lit("[]"))
    return counts.select("lang", "source", group.alias("group"))


def _distance(center: list[Column], spread: list[list[Column]]) -> tuple[list[Column], Column]:
    """Steps of a forward substitution with a Cholesky factor: columns z0, z1, ..., and the sum of their squares."""
    steps = []
    for j, name in enumerate(NAMES):
        rest = F.col(name) - center[j]
        for k in range(j):
            rest = rest - spread[j][k] * F.col(f"z{k}")
        steps.append(rest / spread[j][j])
    return steps, sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(1, len(NAMES))), F.col("z0") * F.col("z0"))


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``distance``, the squared Mahalanobis distance from their group's estimates."""
    names = range(len(NAMES))
    steps, total = _distance([F.col(f"center{j}") for j in names], [[F.col(f"factor{j}_{k}") for k in names] for j in names])
    measured = rows.join(estimates, "group")
    for j, step in enumerate(steps):
        measured = measured.withColumn(f"z{j}", step)
    own = [c for c in rows.columns if c != "distance"]
    return measured.withColumn("distance", total).select(*own, "distance")


def _factors(estimates: DataFrame) -> DataFrame:
    """Cholesky factors of the covariances cov0_0, cov1_0, ..."""
    for j in range(len(NAMES)):
        for k in range(j + 1):
            rest = F.col(f"cov{j}_{k}")
            for m in range(k):
                rest = rest - F.col(f"factor{j}_{m}") * F.col(f"factor{k}_{m}")
            estimates = estimates.withColumn(f"factor{j}_{k}", F.sqrt(rest) if j == k else rest / F.col(f"factor{k}_{k}"))
    return estimates.drop(*(f"cov{j}_{k}" for j in range(len(NAMES)) for k in range(j + 1)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations as first estimates."""
    quantile = lambda c, part=0.5: F.percentile_approx(c, F.lit(part), F.lit(QUANTILE_ACCURACY))
    centers = rows.groupBy("group").agg(*(quantile(n).alias(f"center{j}") for j, n in enumerate(NAMES)))
    near = rows.join(centers, "group")
    deviations = near.groupBy("group").agg(
        *(F.first(f"center{j}").alias(f"center{j}") for j in range(len(NAMES))),
        *(quantile(F.abs(F.col(n) - F.col(f"center{j}"))).alias(f"deviation{j}") for j, n in enumerate(NAMES)),
    )
    for j, (_, least) in enumerate(VECTOR.values()):
        for k in range(j + 1):
            own = F.pow(F.col(f"deviation{j}") * 1.4826, F.lit(2)) + least**2
            deviations = deviations.withColumn(f"cov{j}_{k}", own if j == k else F.lit(0.0))
    return _factors(deviations.drop(*(f"deviation{j}" for j in range(len(NAMES)))))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the rows nearest to the old ones."""
    measured = _measured(rows, estimates)
    limits = measured.groupBy("group").agg(F.percentile_approx("distance", F.lit(NEAREST), F.lit(QUANTILE_ACCURACY)).alias("limit"))
    nearest = measured.join(limits, "group").where("distance <= limit").groupBy("group")
    pairs = [(j, k) for j in range(len(NAMES)) for k in range(j + 1)]
    found = nearest.agg(
        *(F.avg(n).alias(f"center{j}") for j, n in enumerate(NAMES)),
        *((F.covar_pop(NAMES[j], NAMES[k]) * CONSISTENCY + (list(VECTOR.values())[j][1] ** 2 if j == k else 0.0)).alias(f"cov{j}_{k}") for j, k in pairs),
    )
    return _factors(found)


def judged(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The statistics of each row of ``docs`` with base_failed, distance and kept.

    A row is kept if it passes the base rule and its squared distance is at most CUT. Rows that fail the base rule take no
    part in the estimates. Null languages and sources count as empty ones. Sources of fewer than ``least_rows`` rows go
    together by language, then all such; if those are still fewer, they have no distance and are kept.
    """
    rows = statistics(docs).withColumn("base_failed", base_failed())
    rows = rows.withColumns({name: F.when(~F.col("base_failed"), F.expr(x)) for name, (x, _) in VECTOR.items()})
    rows = shared.written(rows, "statistics")
    passed = rows.where(~F.col("base_failed"))
    groups = _groups(passed, least_rows)
    grouped = passed.join(groups, ["lang", "source"]).select("group", *NAMES)
    large = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows).select("group")
    grouped = shared.written(grouped.join(large, "group"), "grouped")
    estimates = shared.written(_start(grouped), "estimates")
    for _ in range(STEPS):
        estimates = shared.written(_concentrated(grouped, estimates), "estimates")
    whole = rows.join(groups, ["lang", "source"], "left")
    measured = _measured(whole.where(~F.col("base_failed")).join(large, "group", "left_semi"), estimates)
    rest = whole.join(large.withColumn("estimated", F.lit(True)), "group", "left")
    rest = rest.where(F.col("base_failed") | F.col("estimated").isNull()).drop("estimated").withColumn("distance", F.lit(None).cast("double"))
    judged_rows = measured.unionByName(rest)
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return judged_rows.withColumn("kept", kept).drop("group", *NAMES)
