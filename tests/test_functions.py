import pytest
from pyspark.sql import functions as F

from solidframe.functions import columns as C
from solidframe.operators import profile
from solidframe.sources.container import encode_number
from solidframe.sources.profiles import flamegraph_entries, parse_samples


def one(spark, column, **values):
    kinds = {int: "long", str: "string", bytes: "binary", bool: "boolean", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "safe"),
    [("a/b", "a/b"), ("a\\.\\b//c", "a/b/c"), ("", None), (".", None), ("/a", None), ("\\a", None), ("C:x", None), ("a/../b", None), ("..", None), ("a\0b", None), ("a/..b", "a/..b"), ("é", "é"), (None, None)],
)
def test_safe_path(spark, name, safe):
    assert one(spark, C.safe_path("n"), n=name) == safe


@pytest.mark.parametrize(
    ("pattern", "name", "hit"),
    [("*.txt", "a/b.txt", True), ("?.txt", "ab.txt", False), ("a[1]", "a[1]", True), ("a[1]", "a1", False), ("A*", "a", False), ("d\\*", "d/x", True), ("d\\*", "d\\x", False), ("a.b", "axb", False), ("*", "a\nb", True), ("a", "a\n", False)],
)
def test_wildcard(spark, pattern, name, hit):
    assert one(spark, C.wildcard("n", [pattern]), n=name) is hit


def test_times(spark):
    assert one(spark, C.to_filetime(F.lit("1969-12-31").cast("timestamp")), x=1) == 0
    assert one(spark, C.from_filetime(F.lit(C.EPOCH_TICKS - 1)), x=1) is None
    assert one(spark, C.from_filetime(F.lit(C.EPOCH_TICKS + 10_000_000)).cast("string"), x=1) == "1970-01-01 00:00:01"


@pytest.mark.parametrize(
    ("code", "props", "text"),
    [("030101", b"\x5d\0\0\0\1", "LZMA:24"), ("030101", b"\x5d\1\0\0\1", "LZMA"), ("21", b"\x18", "LZMA2:24"), ("21", b"\x19", "LZMA2"), ("21", b"\x28", "LZMA2"), ("030401", b"\x06\0\0\0\1", "PPMD:o6:mem24"), ("06F10701", b"\x53\x07", "7zAES:19"), ("03030103", b"", "BCJ"), ("ABCD", b"", "[AB, CD]")],
)
def test_method_text(spark, code, props, text):
    assert one(spark, C.method_text(F.struct(F.col("c").alias("method_id"), F.col("p").alias("properties"))), c=code, p=props) == text


def test_methods(spark):
    rows = C.methods(spark).collect()
    assert len(rows) == 28 and [r.name for r in rows if r.alias] == ["FLZMA2"]
    assert one(spark, C.method_key("n"), n="L-Z_M A2") == "lzma2"
    assert one(spark, C.crypto_last(F.array(F.lit("7zAES:19"), F.lit("LZMA"))), x=1) == ["LZMA", "7zAES:19"]


@pytest.mark.parametrize("prop", [0, 1, 18, 24, 39])
def test_dictionary(spark, prop):
    size = (2 | prop & 1) << (prop // 2 + 11)
    assert one(spark, C.lzma2_dictionary(F.col("p").cast("int")), p=prop) == size and one(spark, C.lzma2_property(F.col("s")), s=size) == prop


@pytest.mark.parametrize("value", [0, 127, 128, 16383, 16384, 2**21, 2**35 - 1, 2**35, 2**49, 2**56 - 1, 2**56, 2**63 - 1])
def test_varint(spark, value):
    assert bytes.fromhex(one(spark, C.varint("v"), v=value)) == encode_number(value)


def test_bits_and_sizes(spark):
    assert [one(spark, C.bitmap_is_set("b", F.col("i")), b=b"\x80\x01", i=i) for i in (0, 1, 15, 16)] == [True, False, True, False]
    assert [one(spark, C.parse_size("s"), s=s) for s in ("64k", "2M", "1g", "7", "0", "", "9x", "99999999999g")] == [65536, 2 << 20, 1 << 30, 7, None, None, None, None]
    assert one(spark, C.mode_text(F.lit(0o100754)), x=1) == "-rwxr-xr--" and one(spark, C.mode_text(F.lit(0o040700)), x=1) == "drwx------"
    assert one(spark, C.raw_name_equals("b", "é"), b="é".encode("utf-16-le"))
    assert one(spark, C.truncated("n", 5), n="abcdefgh") == "ab..."


SVG = "<title>all (10 samples, 100%)</title><title>work (a) (1,200 samples, 12.5%)</title><title>broken</title><title>idle (3 samples, 0.5%)</title>"
PERF = ["app one 12/34 [001] 10.5: 1 cycles:\n\tff01 leaf+0x1f (/lib/x)\n\tff02 mid (/lib/x)\n\tff03 root ([kernel])", "app 35 11.0: 1 cycles:\n\tff01 leaf+0x20 (/lib/x)\n\tff03 root (x)", "app 35 14.5: 1 cycles:", "# comment"]


def test_flamegraph(spark):
    rows = flamegraph_entries(spark.createDataFrame([("s", SVG)], "source string, text string")).collect()
    assert sorted((r.name, r.samples, r.percent) for r in rows) == [("idle", 3, 0.5), ("work (a)", 1200, 12.5)]


def test_samples(spark):
    s = parse_samples(spark.createDataFrame([(x,) for x in PERF], "value string")).cache()
    assert sorted((r.comm, r.tid, r.time, tuple(r.stack)) for r in s.collect()) == [("app", 35, 11.0, ("leaf", "root")), ("app", 35, 14.5, ()), ("app one", 34, 10.5, ("leaf", "mid", "root"))]
    assert [(r.function, r.samples, round(r.percent, 2)) for r in profile.top_functions(s, 5).collect()] == [("leaf", 2, 66.67)]
    assert [(r.caller, r.callee, r.samples) for r in profile.caller_edges(s, 5).collect()] == [("mid", "leaf", 1), ("root", "leaf", 1), ("root", "mid", 1)]
    assert sorted((r.bucket, r.samples) for r in profile.timeline_report(s, 4).collect()) == [(0, 2), (3, 1)]
    assert {r.tid: r.samples for r in profile.thread_breakdown(s).collect()} == {35: 2, 34: 1}
    assert profile.top_functions_per_thread(s, 1).count() == 2


def test_deltas(spark):
    kind = "name string, samples long, percent double"
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 2, 2.0), ("z", 1, 5.0)], kind)
    b = spark.createDataFrame([("y", 2, 2.005), ("z", 9, 9.0), ("n", 4, 4.0)], kind)
    rows = {r.name: r.diff_pct for r in profile.deltas(a, b).collect()}
    assert rows == {"x": -1.0, "z": 4.0, "n": 4.0}
    assert [(r.side, r.name) for r in profile.top_changes(profile.deltas(a, b), 1).orderBy("side").collect()] == [("gain", "n"), ("loss", "x")]
    label = profile.category("name", [("Ends", ["z"]), ("Other x", ["x"])], ("N", ["n"]))
    assert {r.category: r.percent for r in profile.summary(b, label).collect()} == {"Ends": 9.0, "Other": 2.005, "N": 4.0}
    assert profile.key_functions(b, label, 1, 3.0).count() == 2
    assert [r.name for r in profile.search(a, "Y").collect()] == ["y"] and [r.name for r in profile.with_prefix(a, ["x"]).collect()] == [""]
