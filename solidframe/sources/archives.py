"""Solid archives as DataFrames: summary, blocks, entries, packed streams, content, verification.

Archives come as rows (archive, content): from ``read_archives`` (any store that Spark reads), from
``join_volumes``, or built by ``operators.pack``. One pass over them turns headers into nested rows
(``catalog``); every view is a DataFrame over these: offsets are window sums, the entry that owns a stream is
found by a join of ordinals, types by expressions. Encrypted headers are opened first, by Spark's AES over the packed
headers as a column. Content is decoded block by block: a task holds one block,
a block of a solid archive is decoded once, and its entries are cut out and checked by built-in functions.

An archive that can't be read gives one row in ``archives`` with an error and none elsewhere; a block that
can't be decoded gives rows with an error, and other blocks are read on. With ``mode="FAILFAST"`` the error is
raised.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import crypto
from ..functions.crypto import decrypted
from .coders import ArchiveError, decode_folder
from .container import AES, MAGIC, SIGNATURE_SIZE, Cut, OutsideCut, outer_header, parse_archive
from .tables import materialize

_CODER = pa.struct([("method_id", pa.string()), ("num_in", pa.int64()), ("num_out", pa.int64()), ("properties", pa.binary())])
_FOLDER = pa.struct(
    [
        ("coders", pa.list_(_CODER)), ("bind_pairs", pa.list_(pa.struct([("input", pa.int64()), ("output", pa.int64())]))), ("packed_indices", pa.list_(pa.int64())),
        ("coder_sizes", pa.list_(pa.int64())), ("unpack_size", pa.int64()), ("crc", pa.int64()), ("packed", pa.list_(pa.struct([("size", pa.int64()), ("crc", pa.int64())]))),
        ("num_substreams", pa.int64()), ("sizes", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64())),
    ]
)
_FILE = pa.struct(
    [("entry_index", pa.int64()), ("raw_name", pa.binary()), ("empty_stream", pa.bool_()), *((x, pa.decimal128(20, 0)) for x in ("ctime", "atime", "mtime")), ("attributes", pa.int64()), ("start_pos", pa.decimal128(20, 0))]
)
_CATALOG = pa.schema(
    [
        ("archive", pa.string()), ("physical_size", pa.int64()), ("base_offset", pa.int64()), ("major_version", pa.int16()), ("minor_version", pa.int16()), ("next_header_offset", pa.int64()),
        ("next_header_size", pa.int64()), ("header_mode", pa.string()), ("pack_pos", pa.int64()), ("pack_total", pa.int64()), ("folders", pa.list_(_FOLDER)), ("files", pa.list_(_FILE)),
        ("empty_file", pa.list_(pa.bool_())), ("anti", pa.list_(pa.bool_())), ("header_coders", pa.list_(_CODER)), ("error", pa.struct([("code", pa.string()), ("detail", pa.string())])),
    ]
)


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in kind) + ">"
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    return {pa.string(): "string", pa.int64(): "bigint", pa.int16(): "smallint", pa.bool_(): "boolean", pa.binary(): "binary"}[kind]


def _schema(fields: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_ddl(f.type)}" for f in fields)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.7z") -> DataFrame:
    """(archive, content) of the files below ``path``; content is read only where a view needs it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def join_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of volume sets ``name.001, name.002, ...`` below ``path``, each up to its first gap."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.[0-9][0-9][0-9]").option("recursiveFileLookup", "true").load(path)
    parts = parts.select(F.regexp_replace("path", r"[.]\d{3}$", "").alias("archive"), F.regexp_extract("path", r"[.](\d{3})$", 1).cast("int").alias("n"), "content")
    kept = parts.withColumn("place", F.row_number().over(Window.partitionBy("archive").orderBy("n"))).filter(F.col("n") == F.col("place"))
    return join_parts(kept.select("archive", "n", "content"))


def join_parts(parts: DataFrame) -> DataFrame:
    """(archive, content) from the parts (archive, n, content) of each archive, in order."""
    return parts.select("archive", "n", "content").groupBy("archive").applyInArrow(_joined, "archive string, content binary")


def _joined(table: pa.Table) -> pa.Table:
    """The volumes of one set, put together in order."""
    parts = table.sort_by("n").column("content")
    return pa.table({"archive": table.column("archive").slice(0, 1), "content": [b"".join(x.as_py() for x in parts)]}, pa.schema([("archive", pa.string()), ("content", pa.binary())]))


def heads(archives: DataFrame) -> DataFrame:
    """(archive, physical_size, start, at, tail): of each archive the signature header and all from byte ``at`` on, where its header
    lies, or its packed form if that comes first: tasks that parse headers get no packed blocks. An archive that doesn't begin with a
    sound signature header (other bytes before it, damage) is kept whole as ``start``, without ``at``."""
    size, content = F.octet_length("content"), F.col("content")
    signature = F.hex(F.substr("content", F.lit(1), F.lit(SIGNATURE_SIZE)))
    little = lambda at, n: F.conv(F.concat(*(F.substring(signature, 2 * k + 1, 2) for k in reversed(range(at, at + n)))), 16, 10).try_cast("long")
    sound = (size >= SIGNATURE_SIZE) & signature.startswith(MAGIC.hex().upper()) & (F.crc32(F.substr("content", F.lit(13), F.lit(20))) == little(8, 4))
    offset = F.when(sound & (little(12, 8) <= size - SIGNATURE_SIZE), little(12, 8).cast("int"))
    placed = archives.select("archive", "content", size.cast("long").alias("physical_size"), offset.alias("offset"))
    header = F.hex(F.substr("content", F.col("offset") + (SIGNATURE_SIZE + 1), F.lit(16)))
    # a packed header tells first where its stream begins
    packed = F.when(header.startswith("1706"), C.varint_value(F.substring(header, 5, 28)))
    first = F.when(~header.startswith("17"), F.col("offset")).when((packed >= 0) & (packed <= F.col("offset")), packed.cast("int"))
    cut = placed.select("archive", "physical_size", "content", (first + SIGNATURE_SIZE).alias("at"))
    start = F.when(F.col("at").isNull(), content).otherwise(F.substr("content", F.lit(1), F.lit(SIGNATURE_SIZE)))
    return cut.select("archive", "physical_size", start.alias("start"), "at", F.when(F.col("at").isNotNull(), F.substr("content", F.col("at") + 1)).alias("tail"))


def whole_heads(archives: DataFrame) -> DataFrame:
    """The columns of ``heads`` with every archive whole."""
    size, none = F.octet_length("content").cast("long"), F.lit(None)
    return archives.select("archive", size.alias("physical_size"), F.col("content").alias("start"), none.cast("int").alias("at"), none.cast("binary").alias("tail"))


def _cut(batch: pa.RecordBatch, k: int) -> bytes | Cut:
    """An archive of ``heads``."""
    size, start, at, tail = (batch.column(x)[k].as_py() for x in ("physical_size", "start", "at", "tail"))
    return (start or b"") if at is None else Cut(start, at, tail, size)


def _parse(scan: int, failfast: bool, outside: Accumulator | None = None):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sealed = batch.column("sealed")[k].as_py() if "sealed" in batch.schema.names else None
                row = dict.fromkeys(_CATALOG.names) | {x: batch.column(x)[k].as_py() for x in ("archive", "physical_size")}
                try:
                    row |= parse_archive(_cut(batch, k), scan, sealed)
                except OutsideCut:
                    outside.add(1)
                    row |= {"error": {"code": _OUTSIDE, "detail": None}}
                except ArchiveError as e:
                    if failfast:
                        raise
                    row |= getattr(e, "outer", {}) | {"error": {"code": e.code, "detail": e.detail}}
                for f in row["files"] or ():
                    f |= {x: f[x] if f[x] is None else pa.scalar(f[x], pa.decimal128(20, 0)).as_py() for x in ("ctime", "atime", "mtime", "start_pos")}
                yield pa.RecordBatch.from_pylist([row], _CATALOG)

    return parse


_OUTSIDE = "OutsideCut"
_SEALED = pa.schema([("archive", pa.string()), ("properties", pa.binary()), ("size", pa.int64()), ("bytes", pa.binary())])


def _sealed(scan: int):
    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("archive").to_pylist()):
                try:
                    _, _, folder = outer_header(_cut(batch, k), scan)
                except ArchiveError:  # the catalog tells it
                    continue
                fed = {b["input"] for b in folder["bind_pairs"]} if folder else ()
                for n, c in enumerate(folder["coders"] if folder else ()):
                    if c["method_id"] == AES and n not in fed:
                        yield pa.RecordBatch.from_pylist([{"archive": name, "properties": c["properties"] or b"", "size": folder["coder_sizes"][n], "bytes": folder["bytes"]}], _SEALED)

    return sealed


def opened_headers(archives: DataFrame, password: str, max_scan: int = 1 << 20) -> DataFrame:
    """(archive, sealed) of archives with an encrypted header: its bytes with the encryption undone, by Spark's AES."""
    found = heads(archives).mapInArrow(_sealed(max_scan), _schema(_SEALED))
    opened = found.join(crypto.keys(found, password), "properties")
    return opened.select("archive", crypto.decrypt(F.col("bytes"), F.col("key"), F.col("iv"), F.col("size")).alias("sealed"))


def catalog(archives: DataFrame, mode: str = "PERMISSIVE", max_scan: int = 1 << 20, password: str | None = None) -> DataFrame:
    """Headers of ``archives`` (archive, content), one nested row each, written once: views read it several times, and
    their plans don't hold how the archives came about. An encrypted header needs ``password``; without it there is an
    error, with what stands outside. Tasks get the bytes of ``heads``; if a header in its packed form is packed once more and lies
    outside these, its archive is read again as a whole."""
    outside = archives.sparkSession.sparkContext.accumulator(0)

    def parsed(rows: DataFrame) -> DataFrame:
        if password is not None:
            rows = rows.join(opened_headers(archives, password, max_scan), "archive", "left")
        return rows.mapInArrow(_parse(max_scan, mode == "FAILFAST", outside), _schema(_CATALOG))

    found = materialize(parsed(heads(archives)))
    if not outside.value:
        return found
    again = found.filter(F.col("error.code") == _OUTSIDE).select("archive")
    whole = whole_heads(archives.join(again, "archive", "left_semi"))
    return materialize(found.join(again, "archive", "left_anti").unionByName(parsed(whole)))


# ---- views -------------------------------------------------------------------------------------


def archives_view(cat: DataFrame) -> DataFrame:
    """One row per archive: sizes, versions, methods in first-seen order with encryption last, solid, counts."""
    coders = F.flatten(F.transform("folders", lambda f: f["coders"]))
    return cat.select(
        "archive", F.lit("7z").alias("archive_type"), "physical_size", "base_offset", "major_version", "minor_version", "next_header_offset", "next_header_size", "header_mode",
        F.when(F.col("physical_size") >= F.col("pack_total"), F.col("physical_size") - F.col("pack_total")).alias("headers_size"),
        C.crypto_last(F.array_distinct(F.transform(coders, C.archive_method_text))).alias("methods"),
        F.exists("folders", lambda f: f["num_substreams"] > 1).alias("solid"), F.when(F.col("error").isNull(), F.size("folders")).alias("blocks"), F.when(F.col("error").isNull(), F.size("files").cast("long")).alias("num_files"),
        C.crypto_last(F.transform("header_coders", C.archive_method_text)).alias("header_methods"), C.is_encrypted(F.col("header_coders")).alias("header_encrypted"), "error",
    )


def blocks_view(cat: DataFrame) -> DataFrame:
    """One row per block: its coders with their texts, packed streams with offsets in the archive, sizes, checks."""
    block = cat.select("archive", "base_offset", "pack_pos", F.posexplode("folders").alias("block", "f"))
    sized = block.select(
        "archive", "block", "base_offset", "pack_pos", "f.*", F.aggregate("f.packed", F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("packed_size"),
    )
    before = Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("packed_offset", F.col("base_offset") + SIGNATURE_SIZE + F.col("pack_pos") + F.coalesce(F.sum("packed_size").over(before), F.lit(0)))
    decodable = [code for code, _, _, decode, _ in C.METHODS if decode]
    return placed.withColumns(
        {
            "methods": C.crypto_last(F.transform("coders", C.method_text)),
            "encrypted": C.is_encrypted(F.col("coders")),
            "decodable": F.forall("coders", lambda c: c["method_id"].isin(*decodable) & (c["num_in"] == 1)),
        }
    ).drop("base_offset", "pack_pos")


def substreams_view(cat: DataFrame) -> DataFrame:
    """One row per substream: its place in its block (a running sum), its size (the last one's follows from the
    block's) and its ordinal in the archive, over blocks that may have none."""
    f = cat.select("archive", F.posexplode("folders").alias("block", "f")).filter("f.num_substreams > 0")
    explode = f.select("archive", "block", "f.unpack_size", "f.num_substreams", "f.sizes", F.posexplode("f.crcs").alias("substream_index", "crc"))
    told = F.get("sizes", F.col("substream_index"))
    rest = F.col("unpack_size") - F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    size = F.when(F.col("substream_index") == F.col("num_substreams") - 1, rest).otherwise(told)
    inside = Window.partitionBy("archive", "block").orderBy("substream_index").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("archive").orderBy("block", "substream_index")
    out = explode.withColumn("size", F.when(size < 0, F.raise_error(F.lit("Parse: substreams exceed their block"))).otherwise(size))
    out = out.withColumns({"block_offset": F.coalesce(F.sum("size").over(inside), F.lit(0)), "ordinal": F.row_number().over(whole) - 1})
    return out.select("archive", "ordinal", "block", "substream_index", "block_offset", "size", "crc")


def entries_view(cat: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row per entry. Types by flags (bits of empty files and anti-items count entries without a stream);
    the n-th entry with a stream owns the n-th substream; packed_size stands at a block's first substream."""
    blocks = blocks if blocks is not None else blocks_view(cat)
    file = cat.select("archive", "empty_file", "anti", F.explode("files").alias("f")).select("archive", "empty_file", "anti", "f.*")
    order = Window.partitionBy("archive").orderBy("entry_index")
    nth = F.sum(F.col("empty_stream").cast("int")).over(order) - 1
    flag = lambda name: F.col("empty_stream") & F.coalesce(F.get(F.col(name), nth), F.lit(False))
    kinds = file.withColumns({"is_anti": flag("anti"), "is_empty_file": flag("empty_file"), "ordinal": F.when(~F.col("empty_stream"), F.sum((~F.col("empty_stream")).cast("int")).over(order) - 1)})
    path = F.coalesce(F.decode("raw_name", "UTF-16LE"), F.concat(F.lit("unknown-"), F.col("entry_index").cast("string")))
    typed = kinds.withColumns({"path": path, "entry_type": C.entry_type(F.col("is_anti"), F.col("empty_stream"), C.is_symlink("attributes"), F.col("is_empty_file"))})
    sub = substreams_view(cat).join(blocks.select("archive", "block", "packed_size", "methods", "encrypted"), ["archive", "block"])
    out = typed.join(sub, ["archive", "ordinal"], "left")
    lost = ~F.col("empty_stream") & F.col("block").isNull()
    none = F.col("entry_type").isin("EmptyFile", "EmptySymlink")
    return out.select(
        "archive", "entry_index", "path", "raw_name", C.safe_path("path").alias("safe_path"), F.when(lost, F.raise_error(F.lit("Parse: more entries than streams"))).otherwise(F.col("entry_type")).alias("entry_type"),
        F.when(none | (F.col("entry_type") == "Directory"), 0).otherwise(F.col("size")).cast("long").alias("size"), F.when(F.col("substream_index") == 0, F.col("packed_size")).alias("packed_size"), F.when(none, 0).otherwise(F.col("crc")).cast("long").alias("crc"),
        *(C.from_filetime(x).alias(x) for x in ("ctime", "atime", "mtime")), *(F.col(x).alias(f"{x}_ticks") for x in ("ctime", "atime", "mtime")), "attributes", "start_pos",
        F.coalesce("encrypted", F.lit(False)).alias("encrypted"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), "block", "substream_index", "block_offset",
    )


def packed_view(archives: DataFrame, blocks: DataFrame) -> DataFrame:
    """Packed bytes of each block, cut out of the archive by its offset."""
    at = archives.select("archive", "content").join(blocks, "archive")
    return at.select("archive", "block", "coders", "bind_pairs", "coder_sizes", "unpack_size", "packed", "crc", F.substr("content", (F.col("packed_offset") + 1).cast("int"), F.col("packed_size").cast("int")).alias("bytes"))


_DECODED = pa.schema([("archive", pa.string()), ("block", pa.int32()), ("data", pa.binary()), ("crc", pa.int64()), ("code", pa.string()), ("detail", pa.string())])


def _decode(failfast: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                out = {"archive": row["archive"], "block": row["block"], "data": None, "crc": row["crc"], "code": None, "detail": None}
                try:
                    out["data"] = decode_folder(row["coders"], row["bind_pairs"], row["coder_sizes"], row["bytes"], row["unpack_size"])
                except ArchiveError as e:
                    if failfast:
                        raise
                    out |= {"code": e.code, "detail": e.detail}
                yield pa.RecordBatch.from_pylist([out], _DECODED)

    return decode


def decoded_blocks(archives: DataFrame, blocks: DataFrame, mode: str = "PERMISSIVE", password: str | None = None) -> DataFrame:
    """(archive, block, data, error) of each block, decoded once; packed and block checksums are checked.
    Encrypted blocks need ``password``; without it they give an error row."""
    packed = packed_view(archives, blocks)
    one = F.size("packed") == 1
    damaged = one & (F.get("packed", F.lit(0))["crc"] != F.crc32("bytes"))
    sound = packed.withColumn("damaged", F.coalesce(damaged, F.lit(False))).repartition("archive", "block")
    if mode == "FAILFAST":
        sound = sound.withColumn("damaged", F.when(F.col("damaged"), F.raise_error(F.lit("Crc: packed stream"))).otherwise(F.col("damaged")))
    sealed = sound.filter(C.is_encrypted(F.col("coders")) & ~F.col("damaged"))
    if password is None:
        sound = sound.withColumn("damaged", F.col("damaged") | C.is_encrypted(F.col("coders")))
    else:
        sound = decrypted(sound, blocks, password)
    fields = ", ".join(f"{f.name} {'int' if f.name == 'block' else _ddl(f.type)}" for f in _DECODED)
    out = sound.filter("NOT damaged").drop("damaged").mapInArrow(_decode(mode == "FAILFAST"), fields)
    error = F.when(F.col("code").isNotNull(), F.struct("code", "detail")).when(F.col("crc") != F.crc32("data"), F.struct(F.lit("Crc").alias("code"), F.lit("block").alias("detail")))
    good = out.select("archive", "block", "data", error.alias("error"))
    bad = sound.filter("damaged").select("archive", "block", F.lit(None).cast("binary").alias("data"), F.struct(F.lit("Crc").alias("code"), F.lit("packed stream").alias("detail")).alias("error"))
    if password is not None:
        return good.unionByName(bad)
    sealed = sealed.select("archive", "block", F.lit(None).cast("binary").alias("data"), F.struct(F.lit("PasswordRequired").alias("code"), F.lit("encrypted block").alias("detail")).alias("error"))
    return good.unionByName(bad.join(sealed.select("archive", "block"), ["archive", "block"], "left_anti")).unionByName(sealed)


def content_view(entries: DataFrame, decoded: DataFrame) -> DataFrame:
    """Entries that hold data, with it: cut out of their block, checked against their CRC. Filter ``entries`` first
    to decode only the blocks that a selection needs."""
    own = entries.filter(F.col("entry_type").isin("File", "Symlink", "EmptyFile", "EmptySymlink"))
    needed = own.filter("block IS NOT NULL").select("archive", "block").distinct()
    joined = own.join(decoded.join(needed, ["archive", "block"], "left_semi"), ["archive", "block"], "left")
    data = F.when(F.col("block").isNull(), F.lit(b"")).otherwise(F.substr("data", (F.col("block_offset") + 1).cast("int"), F.col("size").cast("int")))
    joined = joined.withColumn("content", data)
    wrong = F.col("error").isNull() & (F.col("crc") != F.crc32("content"))
    error = F.when(wrong, F.struct(F.lit("Crc").alias("code"), F.lit("entry").alias("detail"))).otherwise(F.col("error"))
    return joined.withColumns({"error": error, "content": F.when(error.isNull(), F.col("content"))}).drop("data")


_READ = pa.schema(
    [
        ("archive", pa.string()), ("entry_index", pa.int64()), ("raw_name", pa.binary()), ("empty_stream", pa.bool_()), ("is_anti", pa.bool_()), ("is_empty_file", pa.bool_()), ("mtime_ticks", pa.decimal128(20, 0)), ("attributes", pa.int64()),
        ("block", pa.int32()), ("size", pa.int64()), ("crc", pa.int64()), ("coders", pa.list_(_CODER)), ("content", pa.binary()), ("code", pa.string()), ("detail", pa.string()),
    ]
)


def _read_block(packed: bytes | None, folder: dict, sizes: list[int], opened: bool = False) -> tuple[list[bytes | None], tuple[str | None, str | None]]:
    """Contents of a block's entries, or nothing and the error's code and detail; ``opened``: packed bytes are checked and decrypted already."""
    if packed is None or not opened and len(folder["packed"]) == 1 and folder["packed"][0]["crc"] not in (None, zlib.crc32(packed)):
        return [None] * len(sizes), ("Crc", "packed stream")
    if not opened and any(c["method_id"] == AES for c in folder["coders"]):
        return [None] * len(sizes), ("PasswordRequired", "encrypted block")
    try:
        out = decode_folder(folder["coders"], folder["bind_pairs"], folder["coder_sizes"], packed, folder["unpack_size"])
    except ArchiveError as e:
        return [None] * len(sizes), (e.code, e.detail)
    if folder["crc"] not in (None, zlib.crc32(out)):
        return [None] * len(sizes), ("Crc", "block")
    ends = list(accumulate(sizes, initial=0))
    return [out[a:b] for a, b in pairwise(ends)], (None, None)


def _read_archive(name: str, data: bytes, head: dict, opened: list[dict] | None = None) -> Iterator[list[dict]]:
    """Rows of an archive's entries, block by block; entries without a stream come first. ``opened``: its blocks with encryption undone
    (``bytes``, or none if they are damaged; ``place`` of the coder that was undone), which stand for ``data``."""
    ticks = lambda f: f["mtime"] if f["mtime"] is None else pa.scalar(f["mtime"], pa.decimal128(20, 0)).as_py()
    own = lambda f: {"archive": name, "mtime_ticks": ticks(f), **{x: f[x] for x in ("entry_index", "raw_name", "empty_stream", "attributes")}}
    flag = lambda bits, k: k < len(bits) and bits[k]
    empty = [f for f in head["files"] if f["empty_stream"]]
    yield [own(f) | {"is_anti": flag(head["anti"], k), "is_empty_file": flag(head["empty_file"], k)} for k, f in enumerate(empty)]
    streams = [f for f in head["files"] if not f["empty_stream"]]
    if len(streams) > sum(f["num_substreams"] for f in head["folders"]):
        raise ArchiveError("Parse", "more entries than streams")
    at, first = head["base_offset"] + SIGNATURE_SIZE + head["pack_pos"], 0
    for block, folder in enumerate(head["folders"]):
        n = folder["num_substreams"]
        sizes = [*folder["sizes"], folder["unpack_size"] - sum(folder["sizes"])] if n else []
        if len(sizes) != n or sizes and sizes[-1] < 0:
            raise ArchiveError("Parse", "substreams exceed their block")
        files, first = streams[first : first + n], first + n
        if files:
            if opened is None:
                parts, (code, detail) = _read_block(data[at : at + sum(x["size"] for x in folder["packed"])], folder, sizes)
            else:
                coders = [c | {"method_id": "00"} if k == opened[block]["place"] else c for k, c in enumerate(folder["coders"])]
                parts, (code, detail) = _read_block(opened[block]["bytes"], folder | {"coders": coders}, sizes, True)
            rows = []
            for f, size, crc, part in zip(files, sizes, folder["crcs"], parts, strict=False):
                wrong = part is not None and crc is not None and crc != zlib.crc32(part)
                bad = {"content": None, "code": "Crc", "detail": "entry"} if wrong else {"content": part, "code": code, "detail": detail}
                rows.append(own(f) | {"is_anti": False, "is_empty_file": False, "block": block, "size": size, "crc": crc, "coders": folder["coders"]} | bad)
            yield rows
        at += sum(x["size"] for x in folder["packed"])


def _read(scan: int, failfast: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column("archive")[k].as_py(), batch.column("content")[k].as_py() or b""
                try:
                    head = parse_archive(data, scan)
                except ArchiveError:
                    if failfast:
                        raise
                    continue
                for rows in _read_archive(name, data, head):
                    for row in rows:
                        if failfast and row.get("code"):
                            raise ArchiveError(row["code"], row["detail"])
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return read


def _read_opened(failfast: bool):
    def read(table: pa.Table) -> pa.Table:
        out = []
        for row in table.to_pylist():
            for rows in _read_archive(row["archive"], b"", row, row["opened"]):
                for x in rows:
                    if failfast and x.get("code"):
                        raise ArchiveError(x["code"], x["detail"])
                out.append(pa.RecordBatch.from_pylist(rows, _READ))
        return pa.Table.from_batches(out, _READ)

    return read


def _opened(archives: DataFrame, cat: DataFrame, password: str) -> DataFrame:
    """A row of ``cat`` for each archive with its packed blocks, checked and decrypted where they are: an array in their order."""
    blocks = blocks_view(cat)
    one = F.when(F.size("packed") == 1, F.get("packed", F.lit(0))["crc"]).alias("packed_crc")
    told = blocks.select("archive", "block", "packed_offset", "packed_size", one).join(crypto.locks(blocks, password), ["archive", "block"], "left")
    told = told.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("block", "packed_offset", "packed_size", "packed_crc", "place", "key", "iv", "plain_size"))).alias("told"))
    heads = cat.filter("error IS NULL").select("archive", "base_offset", "pack_pos", "folders", "files", "empty_file", "anti").join(told, "archive", "left")
    packed = lambda x: F.substr("content", (x["packed_offset"] + 1).cast("int"), x["packed_size"].cast("int"))
    plain = lambda x: F.when(x["packed_crc"] != F.crc32(packed(x)), None).when(x["key"].isNull(), packed(x)).otherwise(crypto.decrypt(packed(x), x["key"], x["iv"], x["plain_size"]))
    opened = F.transform("told", lambda x: F.struct(plain(x).alias("bytes"), F.when(x["key"].isNotNull(), x["place"]).alias("place")))
    return archives.select("archive", "content").join(heads, "archive").select("archive", "base_offset", "pack_pos", "folders", "files", "empty_file", "anti", opened.alias("opened"))


def read_whole(archives: DataFrame, mode: str = "PERMISSIVE", max_scan: int = 1 << 20, password: str | None = None) -> DataFrame:
    """The rows of ``content_view`` for many archives of bounded size: each is read by the task that holds it, so that nothing is
    shuffled. A task keeps one archive and one of its blocks. Encrypted blocks are rows with an error; with ``password`` archives
    meet their catalog once and are decrypted and read where they met, a task has one archive and its contents. Archives that can't be
    read give no rows (``archives_view`` tells them). Few large archives are read faster by ``content_view``, which deals their blocks out."""
    fields = ", ".join(f"{f.name} {'int' if f.name == 'block' else _ddl(f.type)}" for f in _READ)
    if password is None:
        rows = archives.select("archive", "content").mapInArrow(_read(max_scan, mode == "FAILFAST"), fields)
    else:
        rows = _opened(archives, catalog(archives, mode, max_scan, password), password).groupBy("archive").applyInArrow(_read_opened(mode == "FAILFAST"), fields)
    kind = C.entry_type(F.col("is_anti"), F.col("empty_stream"), C.is_symlink("attributes"), F.col("is_empty_file"))
    path = F.coalesce(F.decode("raw_name", "UTF-16LE"), F.concat(F.lit("unknown-"), F.col("entry_index").cast("string")))
    typed = rows.withColumns({"path": path, "entry_type": kind}).filter(F.col("entry_type").isin("File", "Symlink", "EmptyFile", "EmptySymlink"))
    none = F.col("block").isNull()
    return typed.select(
        "archive", "entry_index", "path", "raw_name", C.safe_path("path").alias("safe_path"), "entry_type", F.when(none, 0).otherwise(F.col("size")).cast("long").alias("size"), F.when(none, 0).otherwise(F.col("crc")).cast("long").alias("crc"),
        "mtime_ticks", "attributes", F.when(none, F.array().cast("array<string>")).otherwise(C.crypto_last(F.transform("coders", C.method_text))).alias("methods"), "block",
        F.when(F.col("code").isNotNull(), F.struct("code", "detail")).alias("error"), F.when(none, F.lit(b"")).otherwise(F.col("content")).alias("content"),
    )


def content_chunks(content: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Content in pieces: (archive, entry_index, chunk_no, offset, bytes); empty content gives one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / chunk)).cast("int")
    rows = content.select("archive", "entry_index", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    at = F.col("chunk_no") * chunk
    return rows.select("archive", "entry_index", "chunk_no", at.cast("long").alias("offset"), F.substr("content", at + 1, F.lit(chunk)).alias("bytes"))


def verify_view(entries: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row per block: decoded whole and all its entries sound (``CompleteFolders``), or the first error (``Incomplete``)."""
    return verified(content_view(entries.filter("block IS NOT NULL"), decoded))


def verified(content: DataFrame) -> DataFrame:
    """What ``verify_view`` says of the blocks of ``content`` (of ``content_view`` or ``read_whole``)."""
    found = content.filter("block IS NOT NULL").groupBy("archive", "block").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("entry_index"))).alias("error"), F.count(F.lit(1)).alias("entries"))
    return found.select("archive", "block", "entries", F.when(F.col("error").isNull(), "CompleteFolders").otherwise("Incomplete").alias("status"), "error")
