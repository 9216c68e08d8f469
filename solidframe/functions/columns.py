"""Column expressions over archive entries: names, types, methods, times, modes, sizes, bits.

All are built-in Spark functions, so they stay inside generated code and Catalyst can push filters below them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the archive format: ticks (100 ns) from 1601 to 1970, and the bits of entry attributes.
EPOCH_TICKS = 116_444_736_000_000_000
ATTR_DIRECTORY, ATTR_ARCHIVE = 0x10, 0x20
UNIX_EXTENSION = 0x8000
S_IFMT, S_IFDIR, S_IFLNK, S_IFREG = 0o170000, 0o040000, 0o120000, 0o100000


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- names -------------------------------------------------------------------------------------


def safe_path(name: Column | str) -> Column:
    """A relative path without ``.`` and empty parts, or null if the name could leave the target folder."""
    name = _col(name)
    parts = F.filter(F.split(name, r"[/\\]"), lambda x: ~x.isin("", "."))
    unsafe = name.rlike(r"^[/\\]") | name.rlike(r"^[A-Za-z]:") | F.contains(name, F.lit("\0")) | F.array_contains(F.split(name, r"[/\\]"), "..")
    return F.when(~unsafe & (F.size(parts) > 0), F.array_join(parts, "/"))


def wildcard(name: Column | str, patterns: list[str]) -> Column:
    """Whether a name matches any pattern: ``*`` is any run (``/`` too), ``?`` one character, all else literal
    and case-sensitive; a backslash of the pattern means ``/``. No patterns match every name."""
    if not patterns:
        return F.lit(True)
    one = lambda p: "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p.replace("\\", "/"))
    return _col(name).rlike("(?s)^(?:" + "|".join(map(one, patterns)) + r")\z")


def raw_name_equals(raw: Column | str, text: str) -> Column:
    """Comparison of a stored UTF-16LE name with a text, unit by unit."""
    return _col(raw) == F.encode(F.lit(text), "UTF-16LE")


def truncated(name: Column | str, most: int) -> Column:
    """A name of at most ``most`` characters, cut names end in three dots."""
    name = _col(name)
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


# ---- entry types -------------------------------------------------------------------------------


def entry_type(anti: Column, empty_stream: Column, symlink: Column, empty_file: Column) -> Column:
    """Type of an entry; an anti-item first, then by its stream, a symlink's mode, and the empty-file bit."""
    return (
        F.when(anti, "Anti")
        .when(~empty_stream & ~symlink, "File")
        .when(~empty_stream, "Symlink")
        .when(symlink, "EmptySymlink")
        .when(empty_file, "EmptyFile")
        .otherwise("Directory")
    )


def unix_mode(attributes: Column | str) -> Column:
    """Unix mode in the upper half of the attributes, 0 if they hold none."""
    return F.coalesce(F.shiftrightunsigned(_col(attributes).cast("long"), 16), F.lit(0)).cast("int")


def is_symlink(attributes: Column | str) -> Column:
    return unix_mode(attributes).bitwiseAND(S_IFMT) == S_IFLNK


def attributes_of(mode: Column | int, directory: bool = False) -> Column:
    """Attributes that carry a Unix mode."""
    mode = F.lit(mode) if isinstance(mode, int) else mode
    return F.shiftleft(mode.cast("long"), 16).bitwiseOR(F.lit(ATTR_DIRECTORY if directory else ATTR_ARCHIVE))


def mode_text(mode: Column | str) -> Column:
    """A mode as ``drwxr-xr-x``."""
    mode = _col(mode)
    kind = F.when(mode.bitwiseAND(S_IFMT) == S_IFDIR, "d").when(mode.bitwiseAND(S_IFMT) == S_IFLNK, "l").otherwise("-")
    bits = [F.when(mode.bitwiseAND(1 << (8 - k)) != 0, "rwx"[k % 3]).otherwise("-") for k in range(9)]
    return F.concat(kind, *bits)


# ---- times -------------------------------------------------------------------------------------


def from_filetime(ticks: Column | str) -> Column:
    """Timestamp of file-time ticks (100 ns since 1601), null before 1970; the ticks stay the lossless form."""
    ticks = _col(ticks)
    micros = F.floor((ticks.cast("decimal(20,0)") - F.lit(EPOCH_TICKS)) / 10).cast("long")
    return F.when(ticks >= EPOCH_TICKS, F.timestamp_micros(micros))


def to_filetime(time: Column | str) -> Column:
    """File-time ticks of a timestamp, 0 before 1970."""
    micros = F.unix_micros(_col(time))
    return F.when(micros < 0, F.lit(0).cast("decimal(20,0)")).otherwise((micros.cast("decimal(20,0)") * 10 + F.lit(EPOCH_TICKS)).cast("decimal(20,0)"))


# ---- methods -----------------------------------------------------------------------------------

#: Method ids of the archive format, their names, kinds, and whether they are decoded and encoded here.
METHODS = [
    ("00", "Copy", "compression", True, True),
    ("030101", "LZMA", "compression", True, True),
    ("21", "LZMA2", "compression", True, True),
    ("040202", "BZip2", "compression", True, True),
    ("030401", "PPMd", "compression", False, False),
    ("040108", "Deflate", "compression", True, True),
    ("040109", "Deflate64", "compression", False, False),
    ("03030103", "BCJ", "filter", True, True),
    ("0303011B", "BCJ2", "filter", False, False),
    ("03030501", "ARM", "filter", True, False),
    ("0A", "ARM64", "filter", False, False),
    ("03030701", "ARMT", "filter", True, False),
    ("03030401", "IA64", "filter", True, False),
    ("03030205", "PPC", "filter", True, False),
    ("03030805", "SPARC", "filter", True, False),
    ("0B", "RISCV", "filter", False, False),
    ("03", "Delta", "filter", True, True),
    ("020302", "Swap2", "filter", True, False),
    ("020304", "Swap4", "filter", True, False),
    ("04F71101", "ZSTD", "compression", False, False),
    ("04F71102", "BROTLI", "compression", False, False),
    ("04F71104", "LZ4", "compression", False, False),
    ("04F71105", "LZ5", "compression", False, False),
    ("04F71106", "LIZARD", "compression", False, False),
    ("21", "FLZMA2", "compression", True, True),
    ("04F71001", "LZHAM", "compression", False, False),
    ("06F10701", "7zAES", "crypto", True, True),
    ("06F00181", "AES256CBC", "crypto", False, False),
]


def methods(spark) -> "DataFrame":  # noqa: F821
    """The method registry; ``alias`` marks a name whose id another row has first."""
    seen: set[str] = set()
    rows = []
    for code, name, kind, decode, encode in METHODS:
        rows.append(f"('{code}', '{name}', '{kind}', {decode}, {encode}, {code in seen})".replace("True", "true").replace("False", "false"))
        seen.add(code)
    return spark.sql(f"SELECT method_id, name, kind, can_decode, can_encode, alias FROM VALUES {', '.join(rows)} AS m(method_id, name, kind, can_decode, can_encode, alias)")


def method_key(name: Column | str) -> Column:
    """A method name as it is looked up: lower case, without ``-``, ``_`` and spaces."""
    return F.lower(F.translate(_col(name), "-_ ", ""))


def method_name(method_id: Column | str) -> Column:
    """Name of an id in upper-case hexadecimal; unknown ids as a list of bytes."""
    method_id = _col(method_id)
    seen: dict[str, str] = {}
    for code, name, *_ in METHODS:
        seen.setdefault(code, name)
    named = F.create_map(*(F.lit(x) for pair in seen.items() for x in pair))
    raw = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(method_id) / 2).cast("int") - 1), lambda i: F.substr(method_id, i * 2 + 1, F.lit(2))), ", "), F.lit("]"))
    return F.coalesce(F.try_element_at(named, method_id), raw)


def little_endian(data: Column, first: int, size: int) -> Column:
    """Unsigned number in ``size`` bytes of a binary column from its ``first`` (1-based)."""
    digits = F.hex(data)
    swapped = F.concat(*(F.substring(digits, 2 * (first + k) - 1, 2) for k in reversed(range(size))))
    return F.conv(swapped, 16, 10).cast("long")


def byte_at(data: Column, at: int) -> Column:
    return F.conv(F.substring(F.hex(data), 2 * at - 1, 2), 16, 10).cast("int")


def power_bits(size: Column) -> Column:
    """Logarithm of a power of two, null for other sizes."""
    return F.when((size > 0) & (F.bit_count(size) == 1), F.round(F.log2(size)).cast("int"))


def lzma2_dictionary(prop: Column) -> Column:
    """Dictionary size of an LZMA2 property byte, null above 40."""
    size = prop.bitwiseAND(1).bitwiseOR(2).cast("long") * F.pow(F.lit(2.0), F.floor(prop / 2) + 11).cast("long")
    return F.when(prop == 40, F.lit((1 << 32) - 1)).when(prop < 40, size)


def lzma2_property(size: Column) -> Column:
    """Smallest LZMA2 property whose dictionary holds ``size`` bytes."""
    every = F.array(*(F.lit(((2 | p & 1) << (p // 2 + 11)) if p < 40 else (1 << 32) - 1) for p in range(41)))
    return F.size(F.filter(every, lambda x: x < size))


def method_text(coder: Column) -> Column:
    """Text of a coder (struct of method_id in hexadecimal, properties): name and the sizes in its properties."""
    code, props = coder["method_id"], coder["properties"]
    n = F.coalesce(F.octet_length(props), F.lit(0))
    suffix = lambda name, bits: F.when(bits.isNotNull(), F.concat(F.lit(f"{name}:"), bits.cast("string"))).otherwise(F.lit(name))
    lzma = F.when(n == 5, power_bits(little_endian(props, 2, 4)))
    lzma2 = F.when(n == 1, power_bits(lzma2_dictionary(byte_at(props, 1))))
    memory = little_endian(props, 2, 4)
    ppmd = F.when(n == 5, F.concat(F.lit("PPMD:o"), byte_at(props, 1).cast("string"), F.lit(":mem"), F.coalesce(power_bits(memory), memory).cast("string"))).otherwise(F.lit("PPMD"))
    aes = F.when(n > 0, byte_at(props, 1).bitwiseAND(0x3F))
    return F.when(code == "030101", suffix("LZMA", lzma)).when(code == "21", suffix("LZMA2", lzma2)).when(code == "030401", ppmd).when(code == "06F10701", suffix("7zAES", aes)).otherwise(method_name(code))


def archive_method_text(coder: Column) -> Column:
    """The same in an archive's summary, where PPMd and AES show no numbers."""
    return F.when(coder["method_id"] == "030401", F.lit("PPMD")).when(coder["method_id"] == "06F10701", F.lit("7zAES")).otherwise(method_text(coder))


def crypto_last(names: Column) -> Column:
    """Ordered names with encryption moved to the end."""
    crypto = lambda x: x.startswith("7zAES") | x.startswith("AES256CBC")
    return F.concat(F.filter(names, lambda x: ~crypto(x)), F.filter(names, crypto))


def is_encrypted(coders: Column) -> Column:
    return F.exists(coders, lambda c: c["method_id"] == "06F10701")


# ---- numbers and bits --------------------------------------------------------------------------


def parse_size(text: Column | str) -> Column:
    """Bytes of a size such as ``64k``, ``10M`` or ``1g`` (binary units); null if it is none, or zero."""
    text = _col(text)
    number, unit = F.regexp_extract(text, r"^\+?(\d+)([kKmMgG]?)$", 1), F.lower(F.regexp_extract(text, r"^\+?(\d+)([kKmMgG]?)$", 2))
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    value = number.try_cast("decimal(20,0)") * scale.cast("decimal(20,0)")
    return F.when((value > 0) & (value <= F.lit(2**63 - 1)), value.try_cast("long"))


def bitmap_is_set(bitmap: Column | str, index: Column) -> Column:
    """Bit of a binary column, most significant first; false past its end."""
    octet = F.conv(F.substr(F.hex(_col(bitmap)), (F.floor(index / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.coalesce(F.getbit(octet, (7 - index % 8).cast("int")) == 1, F.lit(False))


def varint_value(digits: Column | str) -> Column:
    """The number that starts a hexadecimal text in the format's variable length; the inverse of ``varint``."""
    digits = _col(digits)
    first = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
    low = lambda n: F.conv(F.concat(F.lit("0"), *(F.substring(digits, 3 + 2 * k, 2) for k in reversed(range(n)))), 16, -10).cast("long")
    out = F.when(first < 0x80, first.cast("long"))
    for n in range(1, 8):
        high = first.bitwiseAND(0x7F >> n).cast("long")
        out = out.when(first < 0x100 - (0x80 >> n), F.shiftleft(high, 8 * n).bitwiseOR(low(n)))
    return out.otherwise(low(8))


def bitmap(bits: Column | str) -> Column:
    """An array of booleans as a binary column, most significant bit first, filled up with zeros."""
    bits = _col(bits)
    octets = F.transform(F.sequence(F.lit(0), F.ceil(F.size(bits) / 8).cast("int") - 1), lambda k: F.lpad(F.hex(F.conv(F.rpad(F.array_join(F.transform(F.slice(bits, k * 8 + 1, F.lit(8)), lambda b: F.when(b, "1").otherwise("0")), ""), 8, "0"), 2, 10).cast("int")), 2, "0"))
    return F.when(F.size(bits) > 0, F.unhex(F.array_join(octets, ""))).otherwise(F.lit(b""))


def checked_sum(*values: Column) -> Column:
    """A sum of unsigned 64-bit numbers; past their range it is an error."""
    total = sum((v.cast("decimal(38,0)") for v in values), F.lit(0).cast("decimal(38,0)"))
    return F.when(total >= F.lit(str(2**64)).cast("decimal(38,0)"), F.raise_error(F.lit("Parse: a sum past 64 bits"))).otherwise(total.cast("decimal(20,0)"))


def varint(value: Column | str) -> Column:
    """Number in the format's variable length, hexadecimal: leading ones of the first byte count the bytes
    that follow, little-endian; the rest of the first byte holds the highest bits."""
    value = _col(value).cast("long")
    swapped = lambda x, n: F.concat(*(F.substring(F.lpad(F.hex(x), 2 * n, "0"), 2 * (n - k) - 1, 2) for k in range(n)))
    out = F.lpad(F.hex(value), 2, "0")
    whens = F.when(value < (1 << 7), out)
    for n in range(1, 8):
        head = F.lit((0xFF << (8 - n)) & 0xFF).bitwiseOR(F.shiftrightunsigned(value, 8 * n).cast("int"))
        low = value.bitwiseAND((1 << (8 * n)) - 1)
        whens = whens.when(value < (1 << (7 * n + 7)), F.concat(F.lpad(F.hex(head), 2, "0"), swapped(low, n)))
    return whens.otherwise(F.concat(F.lit("FF"), swapped(value, 8)))
