"""Quality rules: fixed limits, then robust multivariate outliers. DataFrame functions only.

Statistics of each text are transformed into a vector of five: mean word length, log of symbols per word,
share of repeated lines, share of words in repeated windows, share of upper-case A-Z. For each language and
source the centre and scatter of the vectors are estimated by the minimum covariance determinant (Rousseeuw and
Van Driessen 1999): from two starts (distances from the median, plain and scaled by the median absolute deviation)
concentration steps keep the ``SUBSET`` share of documents nearest to the last estimate, for each start of a group
until its determinant no longer falls; the estimate with the smallest determinant is taken and reweighted once.
Both scatters are multiplied by the factors that make them consistent for normal vectors. A document is an outlier
if its squared Mahalanobis distance exceeds a quantile of the chi-square distribution.

Both starts go through each step together, as rows of one narrow table that is written once; a step is a grouped
quantile and grouped sums, both pre-aggregated, so a source with a third of all rows costs no more than others. A
start whose determinant has settled takes no part in further steps.
A language and source with fewer than ``min_group`` documents is judged by the estimate over all documents of its
language, and where those are too few by the estimate over all. With fewer than ``LEAST`` documents in all there is no
estimate. Documents that the fixed limits reject take no part in the estimates.

Cases: null and blank texts have no words and fail; null language or source is a group of its own; repeated
rows are judged each, and alike; empty tables give empty results; columns beyond text, lang, source and
doc_id are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, materialize

FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper")
#: Standard deviations that are added to those of each feature, so that the scatter is regular where most documents
#: have no symbols or repeats at all. Set by judgement, as differences that say nothing about quality: a third of a
#: character, one symbol in twenty words, one line in four, one word or letter in twelve.
FLOORS = (0.35, 0.05, 0.25, 0.08, 0.08)
SUBSET, MAX_STEPS = 0.75, 20
#: Quantiles of distances err by up to one rank in ``ACCURACY``. For normal vectors a share of the subset that errs by e moves
#: the log determinant by (9.4 - 5) / 0.75 e (9.4: squared distance at the edge of the subset, by its own scatter; 5: their mean
#: number of features), so what falls by less than ``TOLERANCE`` has settled as far as the quantile can tell.
ACCURACY, TOLERANCE = 10_000, 1e-3
#: Share of normal vectors that count in the reweighted estimate, and share that would be rejected.
REWEIGHTED, REJECTED = 0.975, 1e-5
#: Documents that an estimate needs: twice the number of features.
LEAST = 2 * len(FEATURES)
WINDOW = 5
_N = len(FEATURES)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]


def chi_square(x: float, k: int) -> float:
    """Distribution function for an odd number k of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for n in range(1, k, 2):
        out -= (x / 2) ** (n / 2) * math.exp(-x / 2) / math.gamma(n / 2 + 1)
    return out


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Factor of a scatter that is estimated from the nearest share of normal vectors."""
    return share / chi_square(chi_square_quantile(share, _N), _N + 2)


def _get(array: Column, i: Column) -> Column:
    return F.get(array, i)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = docs.columns
    words = docs.withColumn("_words", F.filter(F.split(text, SPACE + "+"), lambda x: x != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = words.select(
        *keep,
        F.size("_words").alias("_n"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        lines.alias("_lines"),
    )
    made = ["word_chars", "n_symbols", "n_upper"]
    found = found.select(
        *keep,
        *made,
        "_n",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("_n") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*(_get(F.col("_hashes"), i + k) for k in range(WINDOW)))),
        ).alias("_windows"),
    )
    made += ["n_lines", "n_dup_lines"]
    # only texts with equal windows pay for the rest
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    found = found.select(*keep, *made, "_n", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    twin = lambda x, k: F.coalesce(_get(F.col("_sorted"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(_get(F.col("_sorted"), k + 1)["h"] == x["h"], F.lit(False))
    found = found.select(*keep, *made, "_n", F.array_sort(F.transform(F.filter("_sorted", twin), lambda x: x["i"])).alias("_at"))
    reach = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(_get(F.col("_at"), k + 1) - p, F.lit(WINDOW))))
    repeats = F.coalesce(F.aggregate(reach, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    return found.select(*keep, *made, F.col("_n").cast("long").alias("n_words"), repeats.alias("n_repeat_words"))


def _features() -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    # of short texts the mean word length and the share of capitals vary much: they lean on 20 common words
    length = (F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0)
    upper = F.col("n_upper") / (F.col("word_chars") + 100.0)
    return [length, F.log1p(share("n_symbols", "n_words")), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), upper]


def _groups(stats: DataFrame, min_group: int) -> DataFrame:
    """For each language and source: the pool whose estimate judges it, and the pools that its documents count in."""
    own, lang, every = F.xxhash64(F.lit(0), "_lang", "_source"), F.xxhash64(F.lit(1), "_lang"), F.xxhash64(F.lit(2))
    sizes = materialize(stats.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.count_if(~F.col("base_failed")).alias("n")))
    langs = sizes.groupBy(F.col("_lang").alias("_l")).agg(F.sum("n").alias("in_lang"), F.min("n").alias("least"))
    langs = langs.withColumns({"big": F.col("in_lang") >= min_group, "asked": (F.col("in_lang") >= min_group) & (F.col("least") < min_group)})
    total = langs.agg(F.sum("in_lang").alias("total"), F.coalesce(F.bool_or(~F.col("big")), F.lit(False)).alias("all_asked"))
    named = sizes.join(langs, F.col("_lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(total))  # one row
    enough = F.col("n") >= min_group
    pool = F.when(enough, own).when(F.col("big"), lang).when(F.col("total") >= LEAST, every)
    members = F.array_compact(F.array(F.when(enough, own), F.when(F.col("asked"), lang), F.when(F.col("all_asked") & (F.col("total") >= LEAST), every)))
    return materialize(named.select("_lang", "_source", pool.alias("pool"), members.alias("pools")))


#: Groups up to which tables with a row or two for each are broadcast; larger ones are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def _fit(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre, Cholesky factor of the scatter and its log determinant, for the rows of each key."""
    sums = rows.groupBy(*keys).agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(_N)), *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _PAIRS))
    cov = lambda i, j: (F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (FLOORS[i] ** 2 if i == j else 0.0)
    means = [f"m{i}" for i in range(_N)]
    out = sums.select(*keys, *means, *(cov(i, j).alias(f"c{i}_{j}") for i, j in _PAIRS))
    for j in range(_N):  # column by column
        less = lambda i, j=j: F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{b}") * F.col(f"l{j}_{b}") for b in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(less(j), F.lit(1e-9))))
        if j + 1 < _N:
            out = out.withColumns({f"l{i}_{j}": less(i) / F.col(f"l{j}_{j}") for i in range(j + 1, _N)})
    logdet = sum((F.log(F.col(f"l{j}_{j}")) for j in range(_N)), F.lit(0.0)) * 2
    return out.select(*keys, *means, *(f"l{i}_{j}" for i, j in _PAIRS), logdet.alias("logdet"))


def _distance(rows: DataFrame, fit: DataFrame, keys: list[str], name: str, how: str = "inner") -> DataFrame:
    """``rows`` with the squared distance from the estimate of their key, by forward substitution."""
    keep = [c for c in rows.columns if c != name]
    out = rows.select(*keep).join(fit, keys, how)
    for i in range(_N):
        out = out.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}_{b}") * F.col(f"z{b}") for b in range(i)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
    return out.select(*keep, sum((F.col(f"z{i}") ** 2 for i in range(_N)), F.lit(0.0)).alias(name))


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(c.alias(f"x{i}") for i, c in enumerate(_features())))


def _estimates(stats: DataFrame, groups: DataFrame, bounded) -> DataFrame:
    """The reweighted estimate of each pool; ``bounded`` marks a small table of pools to be broadcast."""
    x = [f"x{i}" for i in range(_N)]
    known = stats.filter("NOT base_failed").join(groups, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = _vectors(known).select(F.explode("pools").alias("pool"), *x)
    middle = materialize(rows.groupBy("pool").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"o{i}") for i, c in enumerate(x))))
    gaps = rows.join(bounded(middle), "pool")
    gap = [F.col(c) - F.col(f"o{i}") for i, c in enumerate(x)]
    spread = materialize(gaps.groupBy("pool").agg(*(F.percentile_approx(F.abs(g), 0.5, 1000).alias(f"a{i}") for i, g in enumerate(gap))))
    plain = sum((g**2 for g in gap), F.lit(0.0))
    scaled = sum((g**2 / ((1.4826 * F.col(f"a{i}")) ** 2 + FLOORS[i] ** 2) for i, g in enumerate(gap)), F.lit(0.0))
    keys = ["pool", "start"]
    rows = materialize(gaps.join(bounded(spread), "pool").select("pool", *x, F.posexplode(F.array(plain, scaled)).alias("start", "d")))
    near, scale, fits, last = rows, consistency(SUBSET), None, None
    for _ in range(MAX_STEPS):
        limits = near.groupBy(*keys).agg(F.percentile_approx("d", SUBSET, ACCURACY).alias("limit"))
        fit = _fit(near.join(bounded(limits), keys).filter("d <= limit"), keys, scale)
        if last is None:
            fit = materialize(fit.withColumn("falls", F.lit(True)))
        else:
            fit = materialize(fit.join(bounded(last), keys).withColumn("falls", F.col("logdet") < F.col("_last") - TOLERANCE).drop("_last"))
        fits = fit if fits is None else fits.unionByName(fit)
        falling = fit.filter("falls")
        if falling.isEmpty():
            break
        near, last = _distance(rows, bounded(falling), keys, "d"), falling.select(*keys, F.col("logdet").alias("_last"))
    best = fits.groupBy("pool").agg(F.min_by(F.struct(*fits.columns), F.struct("logdet", "start")).alias("f")).select("f.*").drop("start", "falls")
    near = _distance(rows.filter("start = 0").drop("start"), bounded(materialize(best)), ["pool"], "d")
    return materialize(_fit(near.filter(F.col("d") <= chi_square_quantile(REWEIGHTED, _N)), ["pool"], consistency(REWEIGHTED)))


def robust_outliers(stats: DataFrame, min_group: int = 50) -> DataFrame:
    """``stats`` (of ``text_statistics``, with base_failed) with the squared distance and the verdict ``outlier``."""
    groups = _groups(stats, min_group)
    bounded = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda table: table)
    groups = bounded(groups)
    named = stats.join(groups.drop("pools"), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    judged = _distance(_vectors(named.select(*stats.columns, "pool")), bounded(_estimates(stats, groups, bounded)), ["pool"], "distance2", "left")
    outlier = F.coalesce(F.col("distance2") > chi_square_quantile(1 - REJECTED, _N), F.lit(False))
    return judged.select(*stats.columns, "distance2", outlier.alias("outlier"))


def quality_rules(docs: DataFrame, min_words: int = 10, repeat_percent: int = 20, min_group: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): statistics, base_failed, distance2, outlier, kept."""
    stats = text_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = robust_outliers(materialize(stats.withColumn("base_failed", failed)), min_group)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
