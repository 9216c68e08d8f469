"""Updating archives: what stays, what is replaced, and which blocks are copied as they are.

``rewrite`` copies the packed bytes of every block that stays whole, whatever its coders (unknown methods and encrypted
blocks too); a block that stays in part is decoded and packed again in its place, new entries follow in blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.archives import content_view, packed_view
from ..sources.tables import materialize
from . import pack
from .solid import assign_folders

ACTIONS = ("CopyRaw", "Decode", "Drop", "NoStream")


def retained(entries: DataFrame, replaced: DataFrame | None = None, deleted: list[str] | None = None, drop: Column | None = None) -> DataFrame:
    """``entries`` with ``retained``: not named (raw_name, compared unit by unit) by ``replaced``, not matching a
    pattern of ``deleted``, not chosen by ``drop``."""
    keep = F.lit(True)
    out = entries
    if replaced is not None:
        names = replaced.select("archive", F.encode("path", "UTF-16LE").alias("raw_name"), F.lit(True).alias("_new")).distinct()
        out = out.join(names, ["archive", "raw_name"], "left")
        keep = keep & F.col("_new").isNull()
    if deleted:
        keep = keep & ~C.wildcard("path", deleted)
    if drop is not None:
        keep = keep & ~drop
    return out.withColumn("retained", keep).drop("_new")


def block_actions(entries: DataFrame) -> DataFrame:
    """``entries`` (with ``retained``) with ``action``: a block that stays whole is copied raw, one that stays in part
    is decoded, the rest is dropped; what has no stream needs neither."""
    block = Window.partitionBy("archive", "block")
    kept, total = F.sum(F.col("retained").cast("int")).over(block), F.count(F.lit(1)).over(block)
    action = F.when(F.col("block").isNull() & F.col("retained"), "NoStream").when(~F.col("retained"), "Drop").when(kept == total, "CopyRaw").otherwise("Decode")
    return entries.withColumn("action", action)


def merged(retained_entries: DataFrame, added: DataFrame) -> DataFrame:
    """Retained entries in their order, then the added ones in theirs, numbered anew: (archive, entry_index, path, ...)."""
    both = [c for c in retained_entries.columns if c in added.columns]
    old = retained_entries.select(*both, F.lit(0).alias("_part"))
    every = old.unionByName(added.select(*both, F.lit(1).alias("_part")))
    order = Window.partitionBy("archive").orderBy("_part", "entry_index")
    return every.withColumn("entry_index", (F.row_number().over(order) - 1).cast("long")).drop("_part")


def update_content(content: DataFrame, added: DataFrame | None = None, deleted: list[str] | None = None) -> DataFrame:
    """Rows to pack again: ``content`` (of ``content_view``) without replaced and deleted names, then ``added``."""
    kept = retained(content, added, deleted).filter("retained").select("archive", "entry_index", "path", F.regexp_replace("entry_type", "^Empty", "").alias("entry_type"), "content", "mtime_ticks", "attributes")
    if added is None:
        return merged(kept, kept.limit(0))
    for name, kind in (("mtime_ticks", "decimal(20,0)"), ("attributes", "bigint")):
        if name not in added.columns:
            added = added.withColumn(name, F.lit(None).cast(kind))
    return merged(kept, added)


def raw_layout_errors(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """Blocks of ``plan`` (archive, block, entry_index, ``position`` in path order among what has a stream) that can't be copied
    raw: each must list all source entries once, in order and together. Entries without a stream are in no block. Rows: archive, block."""
    own = entries.filter("block IS NOT NULL").groupBy("archive", "block").agg(F.sort_array(F.collect_list("entry_index")).alias("source"))
    told = plan.filter("block IS NOT NULL").groupBy("archive", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "entry_index"))), lambda x: x["entry_index"]).alias("told"), (F.max("position") - F.min("position") + 1).alias("reach"), F.count(F.lit(1)).alias("n")
    )
    return told.join(own, ["archive", "block"], "left").filter("source IS NULL OR source <> told OR reach <> n").select("archive", "block")


_TIMES = ("ctime", "atime", "mtime")


def _raw_blocks(archives: DataFrame, blocks: DataFrame, places: DataFrame) -> DataFrame:
    """Packed blocks of ``places`` (archive, block, folder) as they stand in their archives."""
    told = F.slice("sizes", F.lit(1), (F.col("num_substreams") - 1).cast("int"))
    last = F.col("unpack_size") - F.aggregate(told, F.lit(0).cast("long"), lambda n, x: n + x)
    coders = F.array_join(F.transform("coders", lambda c: F.concat(c["method_id"], F.lit(":"), F.lower(F.hex(F.coalesce(c["properties"], F.lit(b"")))))), ";")
    wanted = blocks.join(places, ["archive", "block"])
    cut = packed_view(archives, wanted).select("archive", "block", F.col("bytes").alias("_packed"))
    return wanted.join(cut, ["archive", "block"]).select(
        "archive", "folder", F.col("_packed").alias("packed"), coders.alias("coders"), "coder_sizes", F.concat(told, F.array(last)).alias("sizes"), "crcs", F.col("coders.num_in").alias("inputs"),
        F.col("bind_pairs.input").alias("bind_inputs"), F.col("bind_pairs.output").alias("bind_outputs"), "packed_indices", F.col("packed.size").alias("packed_sizes"), F.col("packed.crc").alias("packed_crcs"), "crc",
    )


def rewrite(
    archives: DataFrame, entries: DataFrame, blocks: DataFrame, decoded: DataFrame, added: DataFrame | None = None, deleted: list[str] | None = None, codec: str = "lzma2", level: int = 5, solid: str = "limit",
    max_files: int | None = None, max_bytes: int | None = None, header_mode: str = "auto", bcj: bool = False, password: str | None = None, cycles: int = 19,
) -> DataFrame:
    """(archive, content) of the archives that ``entries`` and ``blocks`` (views) describe, with ``added`` entries (archive,
    entry_index, path, entry_type, content) added or replaced by name, and those that match ``deleted`` gone.

    Unchanged blocks are copied raw; an error in a block that must be decoded is raised before anything is written.
    An archive that loses all entries stays, empty.
    """
    pack.check_options(codec, header_mode, bcj, password, level)
    if solid == "limit" and max_files is None and max_bytes is None:
        max_bytes = pack.BLOCK_BYTES
    kept = block_actions(retained(entries, added, deleted)).filter("retained")
    old = kept.select(
        "archive", F.lit(0).alias("part"), "entry_index", F.coalesce("raw_name", F.encode("path", "UTF-16LE")).alias("raw_name"), F.regexp_replace("entry_type", "^Empty", "").alias("entry_type"), *(F.col(f"{x}_ticks").cast("decimal(20,0)").cast("long").alias(x) for x in _TIMES), "attributes",
        F.col("block").isNotNull().alias("has_stream"), F.col("block").cast("long").alias("group"), "action",
    )
    every = old
    if added is not None:
        has = added.columns
        size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
        stream = F.col("entry_type").isin("File", "Symlink") & (size > 0)
        new = added.select(
            "archive", F.col("entry_index").cast("long").alias("entry_index"), F.encode("path", "UTF-16LE").alias("raw_name"), "entry_type", stream.alias("has_stream"), size.alias("size"),
            (F.col("mtime_ticks") if "mtime_ticks" in has else F.lit(None)).cast("decimal(20,0)").cast("long").alias("mtime"), (F.col("attributes") if "attributes" in has else F.lit(None)).cast("long").alias("attributes"),
        )
        new = assign_folders(new, solid, max_files, max_bytes).withColumnRenamed("folder", "group")
        none = F.lit(None).cast("long")
        every = old.unionByName(new.select("archive", F.lit(1).alias("part"), "entry_index", "raw_name", "entry_type", none.alias("ctime"), none.alias("atime"), "mtime", "attributes", "has_stream", "group", F.lit("Add").alias("action")))
    whole, block = Window.partitionBy("archive").orderBy("part", "entry_index"), Window.partitionBy("archive", "part", "group")
    placed = every.withColumn("place", (F.row_number().over(whole) - 1).cast("long"))
    # a block stands where its first entry does
    placed = materialize(placed.withColumn("folder", F.when(F.col("has_stream"), F.min(F.when(F.col("has_stream"), F.col("place"))).over(block))))

    streams = placed.filter("has_stream")
    wanted = streams.filter("action = 'Decode'").select("archive", F.col("entry_index").alias("_at"), "place", "folder")
    names = entries.join(wanted.select("archive", F.col("_at").alias("entry_index")), ["archive", "entry_index"], "left_semi")
    failed = F.raise_error(F.concat_ws(": ", F.col("error.code"), "archive", "path")).cast("binary")
    again = content_view(names, decoded).select("archive", F.col("entry_index").alias("_at"), F.when(F.col("error").isNotNull(), failed).otherwise(F.col("content")).alias("content"))
    data = again.join(wanted, ["archive", "_at"]).select("archive", "folder", F.col("place").alias("entry_index"), "content")
    if added is not None:
        fresh = streams.filter("action = 'Add'").select("archive", F.col("entry_index").alias("_at"), "place", "folder")
        data = data.unionByName(added.select("archive", F.col("entry_index").cast("long").alias("_at"), "content").join(fresh, ["archive", "_at"]).select("archive", "folder", F.col("place").alias("entry_index"), "content"))
    copied = _raw_blocks(archives, blocks, streams.filter("action = 'CopyRaw'").select("archive", F.col("group").cast("int").alias("block"), "folder").distinct())
    packed = pack.encode_blocks(data, codec, level, bcj, password, cycles).unionByName(copied)
    files = placed.select(
        "archive", F.col("place").alias("entry_index"), "raw_name", (~F.col("has_stream")).alias("empty_stream"), (F.col("entry_type") == "File").alias("empty_file"), (F.col("entry_type") == "Anti").alias("anti"), *_TIMES, "attributes"
    )
    emptied = entries.select("archive").distinct().join(files.select("archive").distinct(), "archive", "left_anti")
    return pack.assemble(files.unionByName(emptied, allowMissingColumns=True), packed, header_mode, password, cycles)
