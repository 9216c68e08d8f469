import pytest
from pyspark.sql import functions as F

from solidframe import api
from solidframe.functions import crypto
from solidframe.operators import pack
from solidframe.sources import archives as A
from solidframe.sources.coders import ArchiveError
from solidframe.sources.container import build_header, signature_header


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub/deep").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"alpha")
    (root / "sub/b.txt").write_bytes(b"beta" * 100)
    (root / "sub/deep/c.bin").write_bytes(bytes(range(256)))
    (root / "sub.txt").write_bytes(b"x")
    return root


def test_create_list_extract_update(spark, tree, tmp_path):
    built = api.create(spark, str(tree), "t", codec="lzma2", level=1)
    pack.write_files(built.withColumn("name", F.concat("archive", F.lit(".7z"))), str(tmp_path / "out"), "name")
    a = api.Archives.open(spark, str(tmp_path / "out"))
    assert [(r.path, r.entry_type) for r in a.list().collect()] == [("a.txt", "File"), ("sub", "Directory"), ("sub/b.txt", "File"), ("sub/deep", "Directory"), ("sub/deep/c.bin", "File"), ("sub.txt", "File")]
    assert a.state() == api.OK and a.list("*.bin").count() == 1
    a.extract(str(tmp_path / "x"))
    for f in ("a.txt", "sub/b.txt", "sub/deep/c.bin", "sub.txt"):
        assert (tmp_path / "x" / f).read_bytes() == (tree / f).read_bytes()
    with pytest.raises(ArchiveError):
        a.extract(str(tmp_path / "y"), "none*")
    name = a.summary.first().archive
    added = spark.createDataFrame([(name, 0, "new.txt", "File", b"new")], "archive string, entry_index long, path string, entry_type string, content binary")
    b = api.Archives(a.updated(added, ["sub*"], codec="copy"))
    assert [(r.path, bytes(r.content)) for r in b.content().orderBy("entry_index").collect()] == [("a.txt", b"alpha"), ("new.txt", b"new")]
    assert api.Archives(spark.createDataFrame([("x", b"junk")], "archive string, content binary")).state() == api.FATAL


ROWS = "archive string, entry_index long, path string, entry_type string, content binary"


def _packed(a):
    """Packed bytes of each block of one archive, in order."""
    return [bytes(r.bytes) for r in A.packed_view(a.archives, a.blocks).orderBy("block").collect()]


def test_update_copies_whole_blocks(spark):
    rows = [("a", 0, "d", "Directory", b""), *(("a", k, f"f{k}", "File", bytes([65 + k]) * 300) for k in range(1, 7)), ("a", 7, "e", "File", b"")]
    a = api.Archives(pack.pack_archives(spark.createDataFrame(rows, ROWS), codec="lzma", level=1, solid="limit", max_files=2).cache())
    before = _packed(a)
    added = spark.createDataFrame([("a", 0, "n", "File", b"new"), ("a", 1, "f5", "File", b"other"), ("a", 2, "z", "File", b"")], ROWS)
    b = api.Archives(a.updated(added, ["f3"], codec="copy").cache())
    assert [(r.path, r.entry_type, r.block) for r in b.list().collect()] == [
        ("d", "Directory", None), ("f1", "File", 0), ("f2", "File", 0), ("f4", "File", 1), ("f6", "File", 2), ("e", "EmptyFile", None), ("n", "File", 3), ("f5", "File", 3), ("z", "EmptyFile", None),
    ]
    after = _packed(b)
    assert after == [before[0], b"E" * 300, b"G" * 300, b"newother"] and b.state() == api.OK
    assert {r.path: bytes(r.content) for r in b.content().collect()} == {"f1": b"B" * 300, "f2": b"C" * 300, "f4": b"E" * 300, "f6": b"G" * 300, "e": b"", "n": b"new", "f5": b"other", "z": b""}
    gone = api.Archives(b.updated(None, ["*"]).cache())
    assert gone.state() == api.OK and gone.list().count() == 0 and gone.summary.count() == 1
    same = api.Archives(b.updated().cache())
    assert _packed(same) == after and [r.path for r in same.list().collect()] == [r.path for r in b.list().collect()]


def test_update_keeps_what_it_cannot_decode(spark):
    one = lambda code, n_in=1: {"method_id": code, "num_in": n_in, "num_out": 1, "properties": b"p"}
    folders = [  # four inputs and an unknown method, checks of packed streams and of the block
        {"coders": [one("0303011B", 4), one("FE")], "binds": [(1, 1)], "packed_indices": [0, 2, 3, 4], "coder_sizes": [7, 3], "packed_sizes": [1, 2, 3, 4], "packed_crcs": [5, None, 6, 7], "crc": 9, "sizes": [3, 4], "crcs": [1, None]},
        {"coders": [one("00") | {"properties": None}], "coder_sizes": [2], "packed_sizes": [2], "crc": None, "sizes": [2], "crcs": [None]},
    ]
    files = [{"raw_name": x.encode("utf-16-le"), "empty_stream": False} for x in "abc"]
    header, body = build_header(folders, files), bytes(range(10)) + b"cc"
    a = api.Archives(spark.createDataFrame([("x", signature_header(len(body), header) + body + header)], "archive string, content binary"))
    b = api.Archives(a.updated(spark.createDataFrame([("x", 0, "d", "File", b"d")], ROWS), ["c"], codec="copy").cache())
    assert _packed(b) == [bytes(range(10)), b"d"] and [r.path for r in b.list().collect()] == ["a", "b", "d"]
    shape = ("coders", "bind_pairs", "packed_indices", "coder_sizes", "unpack_size", "crc", "packed", "num_substreams")
    assert b.blocks.filter("block = 0").select(*shape).first() == a.blocks.filter("block = 0").select(*shape).first()
    with pytest.raises(Exception, match="UnsupportedCodec"):
        a.updated(None, ["a"]).collect()


def test_symlinks(spark):
    rows = spark.createDataFrame([("a", 0, "l", "Symlink", b"to", 0o120777 << 16), ("a", 1, "e", "Symlink", b"", 0o120777 << 16)], "archive string, entry_index long, path string, entry_type string, content binary, attributes long")
    assert {r.path: r.target for r in api.Archives(pack.pack_archives(rows, codec="copy")).symlinks().collect()} == {"l": "to", "e": ""}


@pytest.mark.parametrize("codec", ["copy", "lzma2"])
def test_encryption(spark, codec):
    data = [bytes(range(n % 256)) * 3 for n in (1, 16, 200)]
    rows = spark.createDataFrame([("a", k, f"f{k}", "File", x) for k, x in enumerate(data)], "archive string, entry_index long, path string, entry_type string, content binary")
    built = pack.pack_archives(rows, codec=codec, level=1, solid="nonsolid", password="sécret", cycles=6).cache()
    right = api.Archives(built, password="sécret")
    assert [bytes(r.content) for r in right.content().orderBy("entry_index").collect()] == [d for d in data if d]
    assert right.list().first().encrypted and "7zAES:6" in right.list().first().methods
    none = api.Archives(built)
    assert {r.error.code for r in none.verify().collect()} == {"PasswordRequired"} and none.state() == api.WARNING
    assert {r.status for r in api.Archives(built, password="other").verify().collect()} == {"Incomplete"}


def test_key_properties():
    for salt, iv in ((b"", b""), (b"s" * 16, b"i" * 16), (b"", b"i" * 8), (b"s", b"")):
        assert crypto.parse_properties(crypto.properties(19, salt, iv)) == (19, salt, (iv + bytes(16))[:16])
    assert crypto.derive_key("p", crypto.RAW_KEY, b"s") == (b"sp\0" + bytes(32))[:32]
    with pytest.raises(ArchiveError):
        crypto.derive_key("p", 25, b"")


def test_encrypted_headers(spark):
    rows = spark.createDataFrame([(x, k, f"f{k}", "File", bytes([65 + k]) * 40) for x in "ab" for k in range(3)] + [("c", 0, "d", "Directory", b"")], ROWS)
    built = pack.pack_archives(rows, codec="lzma2", level=1, password="p", cycles=5, header_mode="encrypted")
    plain = pack.pack_archives(rows.filter("archive = 'a'").withColumn("archive", F.lit("plain")), codec="copy")
    both = built.unionByName(plain).cache()
    shut = {r.archive: r for r in api.Archives(both).summary.collect()}
    assert all(shut[x].error.code == "PasswordRequired" and shut[x].header_encrypted and shut[x].header_methods[-1] == "7zAES" and shut[x].num_files is None for x in "abc")
    assert shut["plain"].error is None and not shut["plain"].header_encrypted
    a = api.Archives(both, password="p")
    assert a.state() == api.OK and {r.archive: r.num_files for r in a.summary.collect()} == {"a": 3, "b": 3, "c": 1, "plain": 3}
    assert {(r.archive, r.path): bytes(r.content) for r in a.content().collect()} == {(x, f"f{k}"): bytes([65 + k]) * 40 for x in ("a", "b", "plain") for k in range(3)}
    wrong = {r.archive: r.error for r in api.Archives(both, password="q").summary.collect()}
    assert wrong["plain"] is None and all(wrong[x].code in ("Crc", "Decompression", "Parse") for x in "abc")
    with pytest.raises(ArchiveError, match="InvalidOptions"):
        pack.pack_archives(rows, header_mode="encrypted")
    again = api.Archives(a.updated(None, ["f0"], codec="copy", password="p", cycles=5, header_mode="encrypted"), password="p")
    assert [r.path for r in again.list().filter("archive = 'b'").collect()] == ["f1", "f2"]


def test_unreadable_keys_are_rows(spark):
    folders = [{"coders": [{"method_id": "06F10701", "properties": props}], "coder_sizes": [16], "packed_sizes": [16], "crc": None, "sizes": [16], "crcs": [None]} for props in (b"\xd3\x11short", bytes([30]), b"")]
    header = build_header(folders, [{"raw_name": x.encode("utf-16-le"), "empty_stream": False} for x in "abc"])
    body = bytes(48)
    a = api.Archives(spark.createDataFrame([("x", signature_header(len(body), header) + body + header)], "archive string, content binary"), password="p")
    assert {r.error.code for r in a.verify().collect()} == {"UnsupportedCodec"} and a.verify().count() == 3


def test_extract_folders_links_and_modes(spark, tmp_path):
    link = 0o120777 << 16
    rows = [("a", 0, "d", "Directory", None, None), ("a", 1, "d/e", "Directory", None, None), ("a", 2, "d/f", "File", b"one", None), ("a", 3, "d/l", "Symlink", b"f", link), ("a", 4, "z", "File", b"", None)]
    kinds = ROWS + ", attributes long"
    a = api.Archives(pack.pack_archives(spark.createDataFrame(rows, kinds), codec="copy"))
    out = tmp_path / "x"
    assert a.extract(str(out)) == (3, 0)
    assert (out / "d/e").is_dir() and (out / "d/l").is_symlink() and (out / "d/l").read_bytes() == b"one" and (out / "z").read_bytes() == b""
    (out / "d/f").write_bytes(b"own")
    assert a.extract(str(out), mode="ignore") == (0, 3) and (out / "d/f").read_bytes() == b"own"
    with pytest.raises(Exception, match="Exists"):
        a.extract(str(out), mode="error")
    assert a.extract(str(out)) == (3, 0) and (out / "d/f").read_bytes() == b"one"
    with pytest.raises(ArchiveError, match="InvalidOptions"):
        a.extract(str(out), mode="ask")
    for target in (b"../../etc", b"/etc/passwd"):
        bad = api.Archives(pack.pack_archives(spark.createDataFrame([("a", 0, "l", "Symlink", target, link)], kinds), codec="copy"))
        with pytest.raises(Exception, match="UnsafePath"):
            bad.extract(str(tmp_path / "y"))


def test_scan_sees_empty_files_and_folders(spark, tree):
    (tree / "none").mkdir()
    (tree / "zero.txt").write_bytes(b"")
    rows = api.disk_entries(spark, str(tree)).orderBy("entry_index").collect()
    assert [(r.path, r.entry_type) for r in rows] == [("a.txt", "File"), ("none", "Directory"), ("sub", "Directory"), ("sub/b.txt", "File"), ("sub/deep", "Directory"), ("sub/deep/c.bin", "File"), ("sub.txt", "File"), ("zero.txt", "File")]
    assert [r.path for r in api.disk_entries(spark, str(tree), pattern="*.bin").orderBy("entry_index").collect()] == ["sub", "sub/deep", "sub/deep/c.bin"]


def test_plans_stay_small(spark):
    """Two updates in a row: the views of the last archives don't hold how the first came about."""
    rows = spark.createDataFrame([("a", k, f"f{k}", "File", bytes([65 + k]) * 30) for k in range(6)], ROWS)
    a = api.Archives(pack.pack_archives(rows, codec="copy", max_files=2))
    for k in range(2):
        added = spark.createDataFrame([("a", 0, f"new{k}", "File", b"n")], ROWS)
        a = api.Archives(a.updated(added, [f"f{k}"], codec="copy"))
    plan = a.content()._jdf.queryExecution().toString()
    assert len(plan) < 1_000_000 and sorted(r.path for r in a.content().collect()) == ["f2", "f3", "f4", "f5", "new0", "new1"]


@pytest.mark.parametrize("name", ["delta1", "delta4", "swap2", "swap4", "bcj", "arm", "armt", "ia64", "ppc", "sparc"])
def test_filters_round_trip(name):
    from solidframe.sources.coders import decode_folder, encode_block

    data = bytes((k * 7 + k // 13) & 255 for k in range(4099))
    packed, coders = encode_block(data, "copy" if name[:4] in ("delt", "swap") else "lzma2", 1, filter_=name)
    assert decode_folder(coders, [{"input": 0, "output": 1}], [len(data)] * 2, packed, len(data)) == data and len(coders) == 2
    for wrong in ("delta0", "delta257", "x86"):
        with pytest.raises(ArchiveError, match="InvalidOptions"):
            encode_block(data, "lzma2", 1, filter_=wrong)
