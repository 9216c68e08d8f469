import lzma
import os
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from solidframe.operators import pack, selection, solid, update
from solidframe.sources import archives as A
from solidframe.sources.tables import materialize
from solidframe.sources.coders import ArchiveError, decode_folder, encode_block
from solidframe.sources.container import Reader, build_header, encode_number, find_signature, parse_archive, signature_header

ENTRIES = [
    ("a", 0, "dir", "Directory", None, None),
    ("a", 1, "dir/one.txt", "File", b"one " * 50, 0o100644 << 16 | 0x20),
    ("a", 2, "dir/empty", "File", b"", None),
    ("a", 3, "gone", "Anti", None, None),
    ("a", 4, "link", "Symlink", b"dir/one.txt", 0o120777 << 16),
    ("a", 5, "dir/two.txt", "File", bytes(range(256)) * 4, None),
    ("a", 6, "../evil", "File", b"x", None),
    ("a", 7, "dir/one.txt", "File", b"again", None),
    ("b", 0, "solo", "File", b"only", None),
]
SCHEMA = "archive string, entry_index long, path string, entry_type string, content binary, attributes long"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, SCHEMA)


def views(built):
    cat = A.catalog(built, mode="FAILFAST").cache()
    blocks = A.blocks_view(cat)
    found = A.entries_view(cat, blocks)
    return cat, blocks, found


@pytest.mark.parametrize("codec", pack.CODECS)
@pytest.mark.parametrize("mode", [{"solid": "solid"}, {"solid": "nonsolid"}, {"solid": "limit", "max_bytes": 300}])
def test_round_trip(spark, entries, codec, mode):
    built = pack.pack_archives(entries, codec=codec, level=1, **mode).cache()
    _, blocks, found = views(built)
    rows = {(r.archive, r.entry_index): r for r in A.content_view(found, A.decoded_blocks(built, blocks, "FAILFAST")).collect()}
    for archive, k, path, kind, content, _ in ENTRIES:
        if kind in ("File", "Symlink"):
            assert (rows[archive, k].path, bytes(rows[archive, k].content)) == (path, content)
    assert {r.status for r in A.verify_view(found, A.decoded_blocks(built, blocks)).collect()} == {"CompleteFolders"}


def test_listing_nulls_and_types(spark, entries):
    _, _, found = views(pack.pack_archives(entries, codec="copy"))
    rows = {r.entry_index: r for r in found.filter("archive = 'a'").collect()}
    assert [rows[k].entry_type for k in range(8)] == ["Directory", "File", "EmptyFile", "Anti", "Symlink", "File", "File", "File"]
    assert [rows[k].size for k in range(8)] == [0, 200, 0, None, 11, 1024, 1, 5]
    assert [rows[k].packed_size for k in range(8)] == [None, 1241, None, None, None, None, None, None]
    assert [rows[k].block_offset for k in (1, 4, 5, 6, 7)] == [0, 200, 211, 1235, 1236]
    assert rows[2].crc == 0 and rows[0].crc is None and rows[1].crc == zlib.crc32(b"one " * 50)
    assert rows[6].safe_path is None and rows[1].safe_path == "dir/one.txt"


def test_summary(spark, entries):
    cat, blocks, found = views(pack.pack_archives(entries, codec="lzma2", level=3, bcj=True))
    rows = {r.archive: r for r in A.archives_view(cat).collect()}
    assert rows["a"].methods == ["BCJ", "LZMA2:22"] and rows["a"].solid and not rows["b"].solid
    assert (rows["a"].header_mode, rows["b"].header_mode, rows["a"].num_files) == ("Encoded", "Plain", 8)
    assert all(r.decodable and not r.encrypted for r in blocks.collect())
    foot = {r.archive: r for r in selection.footer(found).collect()}
    assert (foot["a"].files, foot["a"].folders, foot["a"].size) == (6, 1, 1241)
    lines = selection.technical_listing(found).filter("archive = 'b'").orderBy("line_no").collect()
    assert lines[0].line == "Path = solo" and lines[5].line == f"CRC = {zlib.crc32(b'only'):08X}"


def test_damage_is_a_row(spark, entries):
    built = pack.pack_archives(entries, codec="copy", solid="nonsolid")
    spoil = F.concat(F.substr("content", F.lit(1), F.lit(32)), F.lit(b"!"), F.substr("content", F.lit(34)))
    bad = built.withColumn("content", F.when(F.col("archive") == "a", spoil).otherwise(F.col("content"))).unionByName(spark.createDataFrame([("junk", b"not an archive")], "archive string, content binary"))
    bad = bad.cache()
    cat = A.catalog(bad).cache()
    summary = {r.archive: r for r in A.archives_view(cat).collect()}
    assert summary["junk"].error.code == "Parse" and summary["a"].error is None
    blocks = A.blocks_view(cat)
    status = {(r.archive, r.block): r.status for r in A.verify_view(A.entries_view(cat, blocks), A.decoded_blocks(bad, blocks)).collect()}
    assert status["a", 0] == "Incomplete" and all(v == "CompleteFolders" for k, v in status.items() if k != ("a", 0))
    with pytest.raises(Exception, match="Parse"):
        A.catalog(bad, mode="FAILFAST").collect()


def test_selection(spark, entries):
    _, _, found = views(pack.pack_archives(entries, codec="copy"))
    found = found.cache()
    names = spark.createDataFrame([("a", "dir/one.txt"), ("a", "dir/./two.txt"), ("a", "none")], "archive string, name string")
    assert {r.name: r.entry_index for r in selection.by_name(found, names).collect()} == {"dir/one.txt": 1, "dir/./two.txt": 5, "none": None}
    pick = lambda rows: selection.by_index(found, spark.createDataFrame(rows, "archive string, entry_index long"))
    assert [r.entry_index for r in pick([("a", 5), ("a", 1)]).collect()] == [1, 5]
    assert pick([]).collect() == []
    for wrong in ([("a", 1), ("a", 1)], [("a", 99)]):
        with pytest.raises(ArchiveError):
            pick(wrong)
    assert sorted(r.path for r in selection.by_pattern(found, ["dir\\*.txt"]).collect()) == ["dir/one.txt", "dir/one.txt", "dir/two.txt"]
    groups = {(r.archive, r.block): r.entries for r in selection.block_groups(found.filter("block IS NOT NULL")).collect()}
    assert groups["a", 0] == [1, 4, 5, 6, 7]


def test_update(spark, entries):
    built = pack.pack_archives(entries, codec="copy", solid="limit", max_files=2).cache()
    _, blocks, found = views(built)
    added = spark.createDataFrame([("a", 0, "dir/one.txt", "File", b"new")], "archive string, entry_index long, path string, entry_type string, content binary")
    actions = {(r.archive, r.entry_index): r.action for r in update.block_actions(update.retained(found, added, ["../*"])).collect()}
    assert actions["a", 1] == "Drop" and actions["a", 4] == "Decode" and actions["a", 5] == "Decode" and actions["a", 2] == "NoStream" and actions["b", 0] == "CopyRaw"
    content = A.content_view(found, A.decoded_blocks(built, blocks, "FAILFAST"))
    again = pack.pack_archives(update.update_content(content, added, ["../*"]), codec="copy").cache()
    _, blocks2, found2 = views(again)
    rows = A.content_view(found2, A.decoded_blocks(again, blocks2, "FAILFAST")).filter("archive = 'a'").orderBy("entry_index").collect()
    assert [(r.path, bytes(r.content)) for r in rows] == [("dir/empty", b""), ("link", b"dir/one.txt"), ("dir/two.txt", bytes(range(256)) * 4), ("dir/one.txt", b"new")]
    plan = found.filter("block = 0 AND archive = 'a'").withColumn("position", F.col("entry_index"))
    assert update.raw_layout_errors(found, plan).count() == 1  # entries 1 and 4 don't stand together
    assert update.raw_layout_errors(found, plan.withColumn("position", F.row_number().over(Window.partitionBy("archive").orderBy("entry_index")))).count() == 0


def test_entries_without_a_stream_are_in_no_block(spark, entries):
    """F2, F4."""
    _, _, found = views(pack.pack_archives(entries, codec="copy", solid="limit", max_files=2))
    plan = found.withColumn("position", F.row_number().over(Window.partitionBy("archive").orderBy(F.col("block").isNull(), "entry_index")))
    assert found.filter("block IS NULL").count() > 0 and update.raw_layout_errors(found, plan).count() == 0
    assert selection.block_groups(found).filter("block IS NULL").count() == 0


def test_volumes_and_files(spark, entries, tmp_path):
    built = pack.pack_archives(entries, codec="lzma", level=1).cache()
    data = {r.archive: bytes(r.content) for r in built.collect()}
    parts = pack.volumes(built, [100, 64]).withColumn("name", F.format_string("%s.7z.%03d", "archive", "volume"))
    by = {}
    for r in parts.orderBy("archive", "volume").collect():
        by.setdefault(r.archive, []).append(bytes(r.bytes))
    assert {k: b"".join(v) for k, v in by.items()} == data and all(len(x) == 64 for x in by["a"][1:-1])
    pack.write_files(parts, str(tmp_path / "v"), "name", "bytes")
    joined = A.join_volumes(spark, str(tmp_path / "v")).collect()
    assert {os.path.basename(r.archive)[0]: bytes(r.content) for r in joined} == data
    pack.write_files(built.withColumn("name", F.concat("archive", F.lit(".7z"))), str(tmp_path / "f"), "name")
    read = A.read_archives(spark, str(tmp_path / "f"))
    assert A.archives_view(A.catalog(read)).count() == 2
    _, blocks, found = views(read)
    content = A.content_view(found.filter("path <> '../evil' AND entry_index <> 7"), A.decoded_blocks(read, blocks))
    pack.extract(content, str(tmp_path / "x"))
    assert (tmp_path / "x/dir/one.txt").read_bytes() == b"one " * 50 and (tmp_path / "x/dir/empty").read_bytes() == b""
    with pytest.raises(ArchiveError):
        pack.extract(A.content_view(found, A.decoded_blocks(read, blocks)), str(tmp_path / "y"))
    chunks = A.content_chunks(content, 100).filter("entry_index = 5").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.bytes) for c in chunks) == bytes(range(256)) * 4


def test_stream_of_archives(spark, entries, tmp_path):
    from solidframe.streaming.arrivals import arriving_archives

    built = pack.pack_archives(entries, codec="copy")
    pack.write_files(built.withColumn("name", F.concat("archive", F.lit(".7z"))), str(tmp_path / "in"), "name")
    seen = []
    count = lambda batch, _: seen.append(A.entries_view(materialize(batch)).count())
    arriving_archives(spark, str(tmp_path / "in")).writeStream.foreachBatch(count).trigger(availableNow=True).start().awaitTermination(60)
    assert sum(seen) == len(ENTRIES)


def test_solid_plans(spark):
    sizes = [("a", k, s > 0, s) for k, s in enumerate([50, 60, 0, 30, 200, 10, 10, 0, 10])]
    rows = spark.createDataFrame(sizes, "archive string, entry_index long, has_stream boolean, size long")
    plan = lambda **o: [r.folder for r in solid.assign_folders(rows, **o).orderBy("entry_index").collect()]
    assert plan(solid="solid") == [0] * 9
    assert plan(solid="limit", max_bytes=100) == [0, 1, 1, 1, 2, 3, 3, 3, 3]
    assert plan(solid="limit", max_bytes=100, streaming=True) == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert plan(solid="limit", max_files=2) == [0, 0, 0, 1, 1, 2, 2, 2, 3]
    assert plan(solid="nonsolid")[0:2] == [0, 1]
    with pytest.raises(ValueError):
        plan(solid="other")


def test_options(entries):
    for wrong in ({"codec": "zstd"}, {"header_mode": "none"}, {"codec": "copy", "bcj": True}):
        with pytest.raises(ArchiveError):
            pack.pack_archives(entries, **wrong)


@given(st.integers(0, 2**64 - 1))
def test_numbers(value):
    data = encode_number(value)
    r = Reader(data)
    assert r.number() == value and r.at == len(data) <= 9


@given(st.lists(st.tuples(st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"]), max_size=8), st.booleans(), st.one_of(st.none(), st.integers(0, 2**63))), max_size=20))
def test_file_table(rows):
    files = [{"raw_name": n.encode("utf-16-le"), "empty_stream": True, "empty_file": e, "anti": False, "mtime": t, "attributes": None} for n, e, t in rows]
    header = build_header([], files)
    got = parse_archive(b"stub" + signature_header(0, header) + header)
    assert [(f["raw_name"].decode("utf-16-le"), f["mtime"]) for f in got["files"]] == [(n, t) for n, _, t in rows] and got["base_offset"] == 4
    assert got["empty_file"] == [e for _, e, _ in rows] or not any(e for _, e, _ in rows)


def test_broken_headers():
    header = build_header([], [{"raw_name": "a".encode("utf-16-le"), "empty_stream": True}])
    good = signature_header(0, header) + header
    for k in range(32, len(good)):
        with pytest.raises(ArchiveError):
            parse_archive(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    with pytest.raises(ArchiveError):
        find_signature(b"x" * 100 + good, 50)
    for k in range(len(header)):
        with pytest.raises(ArchiveError):
            cut = header[:k] + b"\xff" * 3
            parse_archive(signature_header(0, cut) + cut)


def test_filters_and_limits():
    data = bytes(range(256)) * 20 + b"abc"
    one = lambda code, props=None: {"method_id": code, "num_in": 1, "num_out": 1, "properties": props}
    for f, code in ((lzma.FILTER_ARM, "03030501"), (lzma.FILTER_POWERPC, "03030205"), (lzma.FILTER_SPARC, "03030805"), (lzma.FILTER_IA64, "03030401"), (lzma.FILTER_ARMTHUMB, "03030701")):
        packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": f}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
        assert decode_folder([one(code), one("21", b"\x10")], [{"input": 0, "output": 1}], [len(data)] * 2, packed, len(data)) == data
    lanes = bytes((data[k] - (data[k - 3] if k >= 3 else 0)) % 256 for k in range(len(data)))
    assert decode_folder([one("03", b"\x02")], [], [len(data)], lanes, len(data)) == data
    swapped = b"".join(data[k : k + 4][::-1] if len(data[k : k + 4]) == 4 else data[k : k + 4] for k in range(0, len(data), 4))
    assert decode_folder([one("020304")], [], [len(data)], swapped, len(data)) == data
    for code in ("04F71101", "030401", "06F10701"):
        with pytest.raises(ArchiveError, match="UnsupportedCodec"):
            decode_folder([one(code)], [], [1], b"x", 1)
    packed, coders = encode_block(data, "lzma")
    for wrong in (lambda: decode_folder(coders, [], [len(data) + 1], packed, len(data) + 1), lambda: decode_folder([one("21", b"\x28")], [], [1], b"\0", 1), lambda: decode_folder(coders, [], [3], b"\xff" * 9, 3)):
        with pytest.raises(ArchiveError):
            wrong()
