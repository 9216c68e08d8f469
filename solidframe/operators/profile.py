"""Reports over profiles: shares, top functions, callers, time buckets, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category(name: Column | str, categories: list[tuple[str, list[str]]], prefixes: tuple[str, list[str]] | None = None) -> Column:
    """The first category with a keyword in the name (whatever its case), then one by prefix, else ``Other``."""
    name = F.col(name) if isinstance(name, str) else name
    lower, out = F.lower(name), None
    for label, words in categories:
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if prefixes:
        hit = F.lit(False)
        for p in prefixes[1]:
            hit = hit | name.startswith(p)
        out = F.when(hit, prefixes[0]) if out is None else out.when(hit, prefixes[0])
    return F.lit("Other") if out is None else out.otherwise("Other")


def top_entries(entries: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """The n entries with the largest percent of at least ``least``."""
    return entries.filter(F.col("percent") >= least).orderBy(F.desc("percent"), "name").limit(n)


def search(entries: DataFrame, pattern: str) -> DataFrame:
    return entries.filter(F.lower("name").contains(pattern.lower()))


def with_prefix(entries: DataFrame, prefixes: list[str]) -> DataFrame:
    """Entries under one of the prefixes, without it."""
    import re

    pattern = "^(?:" + "|".join(map(re.escape, prefixes)) + ")"
    return entries.filter(F.col("name").rlike(pattern)).withColumn("name", F.regexp_replace("name", pattern, ""))


def summary(entries: DataFrame, label: Column) -> DataFrame:
    """Percent summed by category, largest first."""
    return entries.groupBy(label.alias("category")).agg(F.sum("percent").alias("percent")).orderBy(F.desc("percent"), "category")


def key_functions(entries: DataFrame, label: Column, n: int = 5, least: float = 0.5) -> DataFrame:
    """Of each category the first n entries by percent."""
    w = Window.partitionBy("category").orderBy(F.desc("percent"), "name")
    return entries.withColumn("category", label).filter(F.col("percent") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def deltas(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """(name, before_pct, after_pct, diff_pct, before_samples, after_samples): a full outer join by name, missing is 0."""
    one = before.select("name", F.col("percent").alias("before_pct"), F.col("samples").alias("before_samples"))
    two = after.select("name", F.col("percent").alias("after_pct"), F.col("samples").alias("after_samples"))
    joined = one.join(two, "name", "full_outer").fillna(0, ["before_pct", "after_pct", "before_samples", "after_samples"])
    return joined.withColumn("diff_pct", F.col("after_pct") - F.col("before_pct")).filter(F.abs("diff_pct") >= least)


def top_changes(changes: DataFrame, n: int = 30) -> DataFrame:
    """The n largest losses and gains, each kind ranked by itself."""
    side = F.when(F.col("diff_pct") < 0, "loss").otherwise("gain")
    w = Window.partitionBy("side").orderBy(F.abs("diff_pct").desc(), "name")
    return changes.withColumn("side", side).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def counts(samples: DataFrame, *by: Column) -> DataFrame:
    """Samples by some columns with their share in percent."""
    total = samples.agg(F.count(F.lit(1)).alias("total"))
    out = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("samples")).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("percent", F.col("samples") * 100.0 / F.col("total")).drop("total")


def thread_breakdown(samples: DataFrame) -> DataFrame:
    return counts(samples, F.col("tid"), F.col("comm"))


def leaf() -> Column:
    return F.get("stack", F.lit(0))


def top_functions(samples: DataFrame, n: int) -> DataFrame:
    """Functions most often at the top of the stack; shares are of all samples."""
    return counts(samples, leaf().alias("function")).filter("function IS NOT NULL").orderBy(F.desc("samples"), "function").limit(n)


def top_functions_per_thread(samples: DataFrame, n: int, threads: int = 8) -> DataFrame:
    """The n functions most often on top in each of the busiest threads."""
    busy = samples.groupBy("tid", "comm").agg(F.count(F.lit(1)).alias("thread_samples")).orderBy(F.desc("thread_samples"), "tid", "comm").limit(threads)
    own = samples.withColumn("function", leaf()).filter("function IS NOT NULL").groupBy("tid", "comm", "function").agg(F.count(F.lit(1)).alias("samples"))
    w = Window.partitionBy("tid", "comm").orderBy(F.desc("samples"), "function")
    return own.join(F.broadcast(busy), ["tid", "comm"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def caller_edges(samples: DataFrame, n: int) -> DataFrame:
    """The n most frequent (caller, callee): neighbours in a stack, each occurrence counted."""
    pairs = F.transform(F.slice("stack", F.lit(2), F.greatest(F.size("stack") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("caller"), F.get("stack", i).alias("callee")))
    edges = samples.select(F.explode(pairs).alias("e")).select("e.*")
    return edges.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("samples")).orderBy(F.desc("samples"), "caller", "callee").limit(n)


def timeline(samples: DataFrame, buckets: int, time: str = "time") -> DataFrame:
    """``samples`` with ``bucket``: equal widths from the first to the last time, which falls in the last bucket."""
    ends = samples.agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    width = (F.col("_last") - F.col("_first")) / F.lit(float(buckets))
    at = F.floor(F.try_divide(F.col(time) - F.col("_first"), width))
    return samples.crossJoin(F.broadcast(ends)).withColumn("bucket", F.least(at, F.lit(buckets - 1)).cast("int")).drop("_first", "_last")  # one row


def timeline_report(samples: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: samples and the function most often on top."""
    placed = timeline(samples, buckets).withColumn("function", leaf())
    tops = placed.groupBy("bucket", "function").agg(F.count(F.lit(1)).alias("n"))
    return tops.groupBy("bucket").agg(F.sum("n").alias("samples"), F.max_by("function", F.when(F.col("function").isNotNull(), F.struct("n", "function"))).alias("top_function"))


def timeline_by_thread(samples: DataFrame, buckets: int, threads: int = 6) -> DataFrame:
    """Samples of the busiest threads in each bucket: (tid, comm, bucket, samples)."""
    busy = samples.groupBy("tid", "comm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tid", "comm").limit(threads).select("tid", "comm")
    # at most ``threads`` rows
    return timeline(samples, buckets).join(F.broadcast(busy), ["tid", "comm"], "left_semi").groupBy("tid", "comm", "bucket").agg(F.count(F.lit(1)).alias("samples"))


def leaf_categories(samples: DataFrame, categories: list[tuple[str, list[str]]], prefixes: tuple[str, list[str]] | None = None) -> DataFrame:
    """Samples by the category of the function on top, with their share of all that have one."""
    return counts(samples.filter(leaf().isNotNull()), category(leaf(), categories, prefixes).alias("category"))


def ratios(before: DataFrame, after: DataFrame, by: str, value: str) -> DataFrame:
    """Mean timings before and after, and how often the later one goes into the earlier."""
    mean = lambda df, name: df.groupBy(by).agg(F.avg(value).alias(name))
    return mean(before, "before").join(mean(after, "after"), by).withColumn("ratio", F.try_divide("before", "after"))


def phase_diff(primary: DataFrame, other: DataFrame, least: float = 0.1, n: int = 10) -> DataFrame:
    """Functions (function, samples) with a larger share in ``primary`` than in ``other``: the n largest differences."""
    share = lambda df, name: df.crossJoin(F.broadcast(df.agg(F.sum("samples").alias("_t")))).select("function", (F.col("samples") * 100.0 / F.col("_t")).alias(name))
    joined = share(primary, "this_pct").join(share(other, "other_pct"), "function", "left").fillna(0.0, ["other_pct"])
    return joined.withColumn("diff_pct", F.col("this_pct") - F.col("other_pct")).filter(F.col("diff_pct") > least).orderBy(F.desc("diff_pct"), "function").limit(n)


def spread(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, least and largest of timings."""
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"))
