"""Profiler text as DataFrames: flame-graph titles and sampled stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flamegraph_entries(texts: DataFrame) -> DataFrame:
    """(source, name, samples, percent) of the titles ``name (1,234 samples, 5.6%)`` in rows (source, text); the root is left out."""
    titles = texts.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<title>(.*?)</title>"), 1)).alias("title"))
    part = lambda k: F.regexp_extract("title", r"(?s)^(.*)\(([\d,]+) samples.*, ([-+.\deE]+)%[^(]*$", k)
    found = titles.select("source", F.trim(part(1)).alias("name"), F.translate(part(2), ",", "").try_cast("long").alias("samples"), part(3).try_cast("double").alias("percent"))
    return found.filter("samples IS NOT NULL AND percent IS NOT NULL AND name NOT IN ('', 'all')")


def stack_samples(spark: SparkSession, path: str) -> DataFrame:
    """(comm, tid, time, stack) of sampled stacks in text files: samples are parted by blank lines, frames run from the leaf."""
    return parse_samples(spark.read.option("lineSep", "\n\n").text(path))


def parse_samples(texts: DataFrame) -> DataFrame:
    """The same from rows (value), a sample each."""
    lines = F.filter(F.split(F.col("value"), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    row = texts.select(lines.alias("lines")).filter(F.size("lines") > 0).select(F.get("lines", F.lit(0)).alias("head"), F.slice("lines", 2, 1 << 20).alias("frames"))
    head = lambda k: F.regexp_extract("head", r"^\s*(.*?)\s+(?:\d+/)?(\d+)\s+(?:\[[^\]]*\]\s+)?([\d.]+)\s*:", k)
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.rtrim(x), r"^\s*\S+\s+", ""), r" \([^(]*\)?$", ""), r"\+(0x[0-9a-fA-F]*|[0-9a-fA-F]*)$", "")
    stack = F.filter(F.transform("frames", bare), lambda x: x != "")
    return row.select(F.trim(head(1)).alias("comm"), head(2).try_cast("long").alias("tid"), head(3).try_cast("double").alias("time"), stack.alias("stack")).filter("time IS NOT NULL AND tid IS NOT NULL")
