"""Selecting entries: by name, by index, by pattern; what a listing says below its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.coders import ArchiveError


def by_name(entries: DataFrame, names: DataFrame) -> DataFrame:
    """For each row (archive, name) of ``names`` the entry it means: the first with that path, else the first whose
    safe path is the name's. Names without an entry keep nulls, for the caller to report."""
    wanted = names.select(F.col("archive").alias("_archive"), "name", C.safe_path("name").alias("_safe"))
    found = lambda path, name, rank: entries.join(wanted, (F.col("archive") == F.col("_archive")) & (F.col(path) == F.col(name))).select("archive", "name", "entry_index", F.lit(rank).alias("_rank"))
    exact, safe = found("path", "name", 0), found("safe_path", "_safe", 1)
    first = exact.unionByName(safe).groupBy("archive", "name").agg(F.min(F.struct("_rank", "entry_index")).alias("m")).select("archive", "name", F.col("m.entry_index").alias("entry_index"))
    return names.select("archive", "name").distinct().join(first, ["archive", "name"], "left")


def by_index(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """Entries of a selection (archive, entry_index), in archive order. Duplicate and out-of-range indices fail before
    any row is returned; an empty selection gives none."""
    counted = selection.groupBy("archive", "entry_index").agg(F.count(F.lit(1)).alias("n"))
    known = counted.join(entries.select("archive", "entry_index", F.lit(True).alias("known")), ["archive", "entry_index"], "left")
    bad = known.filter("n > 1 OR known IS NULL").limit(1).collect()
    if bad:
        raise ArchiveError("InvalidOptions", f"entry {bad[0]['entry_index']} is {'selected twice' if bad[0]['known'] else 'out of range'}")
    return entries.join(selection, ["archive", "entry_index"], "left_semi").orderBy("archive", "entry_index")


def by_pattern(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Entries whose shown path matches any pattern; no patterns select all."""
    return entries.filter(C.wildcard("path", patterns))


def block_groups(entries: DataFrame) -> DataFrame:
    """Selected entries per block, as one decoder pass reads them: (archive, block, entries, bytes). Entries without a stream are in none."""
    return entries.filter("block IS NOT NULL").groupBy("archive", "block").agg(F.sort_array(F.collect_list("entry_index")).alias("entries"), F.sum("size").alias("bytes"))


def footer(entries: DataFrame) -> DataFrame:
    """Below a listing: files, folders (anti-items are neither), bytes, packed bytes, latest change."""
    return entries.groupBy("archive").agg(
        F.count_if(~F.col("entry_type").isin("Directory", "Anti")).alias("files"), F.count_if(F.col("entry_type") == "Directory").alias("folders"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("packed_size"), F.lit(0)).alias("packed_size"), F.max("mtime").alias("mtime"),
    )


def listing_lines(entries: DataFrame) -> DataFrame:
    """(archive, entry_index, line): a listing with columns of fixed width: time, kind, size, packed size, name."""
    kind = F.when(F.col("entry_type") == "Directory", "D....").otherwise("....A")
    number = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 12, " ")
    time = F.rpad(F.coalesce(F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"), F.lit("")), 19, " ")
    return entries.select("archive", "entry_index", F.concat_ws(" ", time, kind, number("size"), number("packed_size"), F.concat(F.lit(" "), "path")).alias("line"))


def scan_total(entries: DataFrame) -> DataFrame:
    """Entries and bytes of what a scan or listing found, and their share that is packed bytes (null without any)."""
    total = entries.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sum("packed_size").alias("packed"))
    return total.select("archive", "entries", "bytes", F.try_divide("packed", "bytes").alias("ratio"))


def technical_listing(entries: DataFrame) -> DataFrame:
    """(archive, entry_index, line_no, line): the ``key = value`` body of a technical listing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = [
        ("Path", F.col("path")), ("Size", text("size")), ("Packed Size", text("packed_size")), ("Modified", F.coalesce(F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"), F.lit(""))),
        ("Attributes", F.coalesce(C.mode_text(C.unix_mode("attributes")), F.lit(""))), ("CRC", F.coalesce(F.lpad(F.hex("crc"), 8, "0"), F.lit(""))),
        ("Encrypted", F.when(F.col("encrypted"), "+").otherwise("-")), ("Method", F.array_join("methods", " ")), ("Block", text("block")),
    ]
    lines = F.array(*(F.concat(F.lit(f"{k} = "), v) for k, v in pairs))
    return entries.select("archive", "entry_index", F.posexplode(lines).alias("line_no", "line"))


def sizes_in_block(substreams: DataFrame) -> DataFrame:
    """Offsets of substreams (archive, block, substream_index, size) as running sums: first and end."""
    w = Window.partitionBy("archive", "block").orderBy("substream_index").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("size").over(w), F.lit(0))
    return substreams.withColumns({"first": first, "end": first + F.col("size")})
