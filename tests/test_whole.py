"""Many small archives: packed by one task each, read by the task that holds them."""

import pytest
from pyspark.sql import functions as F

from solidframe.operators import pack
from solidframe.sources import archives as A

ROWS = "archive string, entry_index long, path string, entry_type string, content binary"
OWN = ["archive", "entry_index", "path", "raw_name", "safe_path", "entry_type", "size", "crc", "methods", "block", "error", "content"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(a, k, f"d/{k}.txt", "File", bytes([65 + k]) * (k * 37 % 90)) for a in ("a", "b") for k in range(9)]
    made += [("a", 9, "link", "Symlink", b"d/1.txt"), ("a", 10, "d", "Directory", None), ("a", 11, "gone", "Anti", None), ("a", 12, "nothing", "Symlink", b""), ("c", 0, "e", "File", None)]
    return spark.createDataFrame(made, ROWS)


def _known(df):
    return sorted((tuple(r) for r in df.select(*OWN).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("options", [{"codec": "copy"}, {"codec": "lzma2", "level": 1, "max_files": 3}, {"codec": "deflate", "solid": "nonsolid"}, {"codec": "copy", "filter_": "delta4", "header_mode": "plain"}])
def test_whole_archives_are_the_same(rows, options):
    plain, whole = pack.pack_archives(rows, **options), pack.pack_archives(rows, whole=True, **options)
    apart = pack.pack_archives(rows.withColumn("size", F.octet_length("content")).withColumn("key", F.concat("archive", "path")).drop("content"), contents=rows.select(F.concat("archive", "path").alias("key"), "content"), whole=True, **options)
    told = lambda df: {r.archive: bytes(r.content) for r in df.collect()}
    assert told(plain) == told(whole) == told(apart)
    cat = A.catalog(plain)
    blocks = A.blocks_view(cat)
    assert _known(A.read_whole(whole)) == _known(A.content_view(A.entries_view(cat, blocks), A.decoded_blocks(plain, blocks)))


def test_several_encodings_of_one_grouping(rows):
    """all filters from one shuffle of the content, read back without any."""
    data = rows.filter("octet_length(content) > 0").select("archive", F.lit(0).alias("folder"), "entry_index", "content")
    files = rows.select("archive", "entry_index", F.encode("path", "UTF-16LE").alias("raw_name"), (F.coalesce(F.octet_length("content"), F.lit(0)) == 0).alias("empty_stream"), (F.col("entry_type") == "File").alias("empty_file"), (F.col("entry_type") == "Anti").alias("anti"))
    built = pack.pack_whole(files, data, [("x-", "copy", 1, False, "swap2"), ("y-", "lzma2", 1, False, "arm")])
    read = A.read_whole(built, "FAILFAST")
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    found = {(r.archive, r.entry_index): bytes(r.content) for r in read.collect()}
    want = {(r.archive, r.entry_index): bytes(r.content or b"") for r in rows.filter("entry_type IN ('File', 'Symlink') AND path <> 'nothing'").collect()}
    assert found == {(p + a, k): v for p in ("x-", "y-") for (a, k), v in want.items()}


def test_damage_and_passwords_are_rows(spark, rows):
    built = pack.pack_archives(rows, codec="copy", max_files=2, whole=True)
    other = F.concat(F.substr("content", F.lit(1), F.lit(32)), F.lit(b"\xff"), F.substr("content", F.lit(34)))
    bad = built.select("archive", F.when(F.col("archive") == "a", other).otherwise(F.col("content")).alias("content")).unionByName(spark.createDataFrame([("junk", b"none")], "archive string, content binary"))
    cat = A.catalog(bad)
    blocks = A.blocks_view(cat)
    assert _known(A.read_whole(bad)) == _known(A.content_view(A.entries_view(cat, blocks), A.decoded_blocks(bad, blocks)))
    with pytest.raises(Exception, match="Crc"):
        A.read_whole(bad.filter("archive = 'a'"), "FAILFAST").collect()
    sealed = A.read_whole(pack.pack_archives(rows, codec="copy", password="x", cycles=1, whole=True)).filter("block IS NOT NULL").select("error.code", "content").distinct().collect()
    assert [tuple(r) for r in sealed] == [("PasswordRequired", None)]


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """the driver names no folder or file of a mounted tree itself."""
    from solidframe.sources import disk

    for k in range(30):
        (tmp_path / f"t/{k % 3}/f{k}").mkdir(parents=True)
        (tmp_path / f"t/{k % 3}/{k}.txt").write_bytes(b"x" * (k % 2))
    (tmp_path / "t/.0.txt.crc").write_bytes(b"")
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, _make=type(spark).createDataFrame, **b: made.append(len(data)) or _make(self, data, *a, **b))
    rows = disk.disk_entries(spark, str(tmp_path / "t")).collect()
    assert sorted((r.path, r.entry_type) for r in rows) == sorted([(str(k), "Directory") for k in range(3)] + [(f"{k % 3}/f{k}", "Directory") for k in range(30)] + [(f"{k % 3}/{k}.txt", "File") for k in range(30)])
    assert made == [1]


def test_catalogs_get_headers_only(spark):
    """tasks that parse headers get no packed blocks; archives whose header lies elsewhere are read whole."""
    import os
    import zlib

    from solidframe.sources.coders import encode_block
    from solidframe.sources.container import build_header, encoded_header, parse_archive, signature_header

    made = [("n", k, f"{k}.bin", "File", os.urandom(100_000)) for k in range(20)]
    built = {mode: pack.pack_archives(spark.createDataFrame(made, ROWS), codec="copy", max_files=4, header_mode=mode, whole=True).first().content for mode in ("plain", "encoded")}
    built = {mode: bytes(x) for mode, x in built.items()} | {"encrypted": bytes(pack.pack_archives(spark.createDataFrame(made, ROWS), codec="copy", password="p", cycles=1, header_mode="encrypted").first().content)}
    # a header packed twice, the inner one in front
    plain = build_header([], [{"raw_name": b"x\0", "empty_stream": True, "empty_file": True}])
    one, coders = encode_block(plain, "lzma")
    middle = encoded_header(len(plain), zlib.crc32(plain), len(one), 0, coders, [len(plain)])
    two, coders = encode_block(middle, "lzma")
    outer = encoded_header(len(middle), zlib.crc32(middle), len(two), len(one), coders, [len(middle)])
    built["twice"] = signature_header(len(one) + len(two), outer) + one + two + outer
    odd = {"prefixed": b"MZ" + built["plain"], "trailing": built["encoded"] + b"more", "cut": built["plain"][:-9], "flipped": built["encoded"][:9] + b"\0" + built["encoded"][10:], "short": built["plain"][:20], "empty": b"", "far": signature_header(1 << 63, b"x"), "none": signature_header(0, b"")}
    archives = spark.createDataFrame(list((built | odd).items()) + [("null", None)], "archive string, content binary")
    sent = {r.archive: r.n for r in A.heads(archives).select("archive", F.expr("coalesce(octet_length(start), 0) + coalesce(octet_length(tail), 0)").alias("n")).collect()}
    assert max(sent[x] for x in (*built, "trailing")) < 2000 < 1_000_000 < sent["prefixed"]
    found = {r.archive: r for r in A.catalog(archives, password="p").collect()}
    assert found.keys() == {*built, *odd, "null"}
    for name, data in (built | odd).items():
        row = found[name].asDict(True)
        try:
            want = parse_archive(data) if name != "encrypted" else {"header_mode": "Encoded"}
        except Exception as e:
            assert (row["error"]["code"], row["error"]["detail"]) == (e.code, e.detail), name
        else:
            assert row["error"] is None and row["physical_size"] == len(data) and {k: row[k] for k in want if k not in ("files", "folders", "header_coders")} == {k: v for k, v in want.items() if k not in ("files", "folders", "header_coders")}, name
            assert [bytes(f["raw_name"]) for f in row["files"]] == [f["raw_name"] for f in want.get("files", row["files"])] and len(row["folders"]) == len(want.get("folders", row["folders"]))
    assert len(found["encrypted"].files) == 20 and found["null"].error.code == "Parse"


@pytest.mark.parametrize("options", [{"codec": "copy"}, {"codec": "lzma2", "level": 1, "max_files": 3, "header_mode": "encrypted"}, {"codec": "lzma2", "level": 1, "bcj": True, "max_files": 2, "header_mode": "plain"}])
def test_encrypted_archives_are_packed_and_read_by_one_task_each(rows, options):
    """the same sizes and entries as blocks dealt out, content shuffled by archive only and packed bytes once when read."""
    import re

    plain, whole = (pack.pack_archives(rows, password="x", cycles=3, whole=w, **options) for w in (False, True))
    told = lambda df: {r.archive: len(r.content) for r in df.collect()}
    if options.get("header_mode") == "plain":  # packed headers hold random bytes, and their size varies
        assert told(plain) == told(whole)
    cat = A.catalog(plain, password="x")
    blocks = A.blocks_view(cat)
    read = A.read_whole(whole, "FAILFAST", password="x")
    want = _known(A.content_view(A.entries_view(cat, blocks), A.decoded_blocks(plain, blocks, password="x")))
    assert _known(read) == want == _known(A.read_whole(plain, password="x"))
    cat = A.catalog(whole, password="x")
    blocks = A.blocks_view(cat)
    assert _known(A.content_view(A.entries_view(cat, blocks), A.decoded_blocks(whole, blocks, password="x"))) == want
    vectors = [bytes(c.properties)[-16:] for b in blocks.select("coders").collect() for c in b.coders if c.method_id == "06F10701"]
    assert len(set(vectors)) == len(vectors) > 1
    shuffled = [x for x in re.findall(r"Exchange hashpartitioning.*\n.*", read._jdf.queryExecution().executedPlan().toString()) if "content" in x]
    assert len(shuffled) <= 1


def test_damaged_encrypted_blocks_are_rows(rows):
    built = pack.pack_archives(rows, codec="copy", max_files=2, password="x", cycles=2, whole=True)
    other = F.concat(F.substr("content", F.lit(1), F.lit(32)), F.lit(b"\xff\xff"), F.substr("content", F.lit(35)))
    bad = built.select("archive", F.when(F.col("archive") == "a", other).otherwise(F.col("content")).alias("content"))
    cat = A.catalog(bad, password="x")
    blocks = A.blocks_view(cat)
    found = _known(A.read_whole(bad, password="x"))
    assert found == _known(A.content_view(A.entries_view(cat, blocks), A.decoded_blocks(bad, blocks, password="x")))
    assert {r[0] for r in found if r[10]} == {"a"}
    wrong = A.read_whole(built, password="y").filter("block IS NOT NULL").select("error.code").distinct().collect()
    assert [r.code for r in wrong] == ["Crc"]
    with pytest.raises(Exception, match="Crc"):
        A.read_whole(bad, "FAILFAST", password="x").collect()


@pytest.mark.parametrize(("whole", "codec"), [(True, "copy"), (False, "bzip2"), (True, "lzma2")])
def test_streams_of_no_bytes(rows, whole, codec):
    """empty files count in their blocks if told so, also where a block has no others, and are read as they were."""
    files = rows.filter("entry_type IN ('File', 'Symlink')")
    built = pack.pack_archives(files, codec=codec, level=1, max_files=2, whole=whole, empty_streams=True)
    cat = A.catalog(built, "FAILFAST")
    blocks = A.blocks_view(cat)
    entries = A.entries_view(cat, blocks)
    told = {(r.archive, r.entry_index): (r.block, r.entry_type) for r in entries.collect()}
    assert [told["b", k][0] for k in range(9)] == [k // 2 for k in range(9)] and told["c", 0] == (0, "File") and told["a", 10] == (5, "File")
    want = {(r.archive, r.path): bytes(r.content or b"") for r in files.collect()}
    for read in (A.read_whole(built, "FAILFAST"), A.content_view(entries, A.decoded_blocks(built, blocks, "FAILFAST"))):
        assert {(r.archive, r.path): bytes(r.content) for r in read.collect()} == want
    assert {r.status for r in A.verify_view(entries, A.decoded_blocks(built, blocks)).collect()} == {"CompleteFolders"}
