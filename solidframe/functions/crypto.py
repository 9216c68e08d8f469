"""Encrypted blocks with Spark's own AES: keys from passwords, CBC without padding.

Spark's ``aes_decrypt`` checks and strips a padding block, which archives don't have. A block that decrypts to
padding is appended first: the encryption of no data, with the last ciphertext block as initialisation vector.
``aes_encrypt`` prefixes the vector and appends such a block; both are cut off.

Passwords are read from an environment variable or file by the caller and passed as values; they appear in no
plan string: keys are derived in tasks, one for each distinct (cycles, salt), and joined as data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.coders import ArchiveError

AES = "06F10701"
#: Rounds are two to this power at most; the special value takes salt and password as the key itself.
MAX_CYCLES, RAW_KEY = 24, 0x3F


def derive_key(password: str, cycles: int, salt: bytes) -> bytes:
    """Key of 32 bytes: SHA-256 over 2^cycles repetitions of salt, password and a counter."""
    secret = salt + password.encode("utf-16-le")
    if cycles == RAW_KEY:
        return (secret + bytes(32))[:32]
    if cycles > MAX_CYCLES:
        raise ArchiveError("ResourceLimitExceeded", f"2^{cycles} key rounds")
    out = hashlib.sha256()
    for k in range(0, 1 << cycles, 1024):
        out.update(b"".join(secret + n.to_bytes(8, "little") for n in range(k, min(k + 1024, 1 << cycles))))
    return out.digest()


def properties(cycles: int, salt: bytes, iv: bytes) -> bytes:
    """Coder properties that tell cycles, salt and initialisation vector."""
    if not salt and not iv:
        return bytes([cycles])
    head = cycles | 0x80 * bool(salt) | 0x40 * bool(iv)
    return bytes([head, max(len(salt) - 1, 0) << 4 | max(len(iv) - 1, 0)]) + salt + iv


def parse_properties(props: bytes) -> tuple[int, bytes, bytes]:
    """(cycles, salt, initialisation vector of 16 bytes)."""
    if not props:
        raise ArchiveError("Parse", "no encryption properties")
    head, sizes = props[0], props[1] if props[0] & 0xC0 else 0
    n_salt, n_iv = (head >> 7 & 1) + (sizes >> 4), (head >> 6 & 1) + (sizes & 15)
    body = props[2:]
    if len(body) != n_salt + n_iv and head & 0xC0:
        raise ArchiveError("Parse", "encryption properties of wrong length")
    return head & 0x3F, body[:n_salt], (body[n_salt : n_salt + n_iv] + bytes(16))[:16]


def decrypt(data: Column, key: Column, iv: Column, size: Column) -> Column:
    """``size`` bytes of CBC ciphertext without padding."""
    last = F.substr(data, F.octet_length(data) - 15, F.lit(16))
    padding = F.substr(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("DEFAULT"), last), F.lit(17), F.lit(16))
    return F.substr(F.aes_decrypt(F.concat(iv, data, padding), key, F.lit("CBC")), F.lit(1), size.cast("int"))


def encrypt(data: Column, key: Column, iv: Column) -> Column:
    """CBC ciphertext of data filled up with zeros to whole blocks."""
    n = F.octet_length(data)
    whole = F.concat(data, F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(16)))))
    return F.substr(F.aes_encrypt(whole, key, F.lit("CBC"), F.lit("DEFAULT"), iv), F.lit(17), F.octet_length(whole))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("properties", pa.binary()), ("cycles", pa.int32()), ("salt", pa.binary()), ("iv", pa.binary())])
    for batch in batches:
        rows = []
        for props in batch.column("properties").to_pylist():
            try:
                cycles, salt, iv = parse_properties(props or b"")
            except ArchiveError:  # without a key its blocks are rows with an error
                continue
            if cycles <= MAX_CYCLES or cycles == RAW_KEY:
                rows.append({"properties": props, "cycles": cycles, "salt": salt, "iv": iv})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _derived(password: str):
    schema = pa.schema([("cycles", pa.int32()), ("salt", pa.binary()), ("key", pa.binary())])

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cycles, salt in zip(batch.column("cycles").to_pylist(), batch.column("salt").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"cycles": cycles, "salt": salt, "key": derive_key(password, cycles, salt)}], schema)

    return derive


def keys(used: DataFrame, password: str) -> DataFrame:
    """(properties, key, iv) for the encryption ``properties`` in ``used``; those that can't be read are left out."""
    parsed = used.select("properties").distinct().mapInArrow(_parsed, "properties binary, cycles int, salt binary, iv binary")
    derived = parsed.select("cycles", "salt").distinct().repartition("cycles", "salt").mapInArrow(_derived(password), "cycles int, salt binary, key binary")
    return parsed.join(derived, ["cycles", "salt"]).select("properties", "key", "iv")


def _reading(blocks: DataFrame, place: str, props: str) -> DataFrame:
    """``blocks`` with the place of the coder that reads the packed stream, and its properties if it is an encryption."""
    # the coder whose input nothing feeds
    fed = F.transform("bind_pairs", lambda b: b["input"])
    first = F.get(F.filter(F.sequence(F.lit(0), F.size("coders") - 1), lambda k: ~F.array_contains(fed, k.cast("long"))), F.lit(0))
    at = blocks.withColumn(place, first)
    return at.withColumn(props, F.when(F.get("coders", F.col(place))["method_id"] == AES, F.get("coders", F.col(place))["properties"]))


def locks(blocks: DataFrame, password: str) -> DataFrame:
    """(archive, block, place, key, iv, plain_size) of the blocks whose packed stream is encrypted: ``place`` is that of their encryption
    among the coders, ``plain_size`` how many bytes it gives."""
    sealed = _reading(blocks, "place", "properties").filter("properties IS NOT NULL")
    return sealed.join(keys(sealed, password), "properties").select("archive", "block", "place", "key", "iv", F.get("coder_sizes", F.col("place")).alias("plain_size"))


def decrypted(packed: DataFrame, blocks: DataFrame, password: str) -> DataFrame:
    """Rows of ``packed_view`` with the encryption that reads the packed stream undone; its coder becomes a copy."""
    at = _reading(packed, "_at", "_props")
    used = blocks.select(F.explode("coders").alias("c")).filter(F.col("c.method_id") == AES).select("c.properties")
    joined = at.join(keys(used, password), F.col("_props") == F.col("properties"), "left")
    plain = F.when(F.col("key").isNotNull(), decrypt(F.col("bytes"), F.col("key"), F.col("iv"), F.get("coder_sizes", F.col("_at")))).otherwise(F.col("bytes"))
    copy = lambda c, k: F.when(F.col("key").isNotNull() & (k == F.col("_at")), c.withField("method_id", F.lit("00"))).otherwise(c)
    return joined.withColumns({"bytes": plain, "coders": F.transform("coders", copy)}).select(packed.columns)
