"""Headers of solid-archive containers: bytes to plain rows and back.

Only the layout of the format lives here; what rows mean (types, offsets, which entry owns which stream) is
worked out by DataFrame operations in ``archives``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .coders import ArchiveError, decode_folder

#: Fixed values of the archive format: its magic and the ids of its properties.
MAGIC = b"7z\xbc\xaf\x27\x1c"
END, HEADER, ARCHIVE_PROPERTIES, ADDITIONAL_STREAMS, MAIN_STREAMS, FILES = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05
PACK_INFO, UNPACK_INFO, SUBSTREAMS, SIZE, CRC, FOLDER, CODER_SIZES, NUM_STREAMS = 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0D
EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, CTIME, ATIME, MTIME, ATTRIBUTES, ENCODED_HEADER, START_POS, DUMMY = 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x17, 0x18, 0x19
SIGNATURE_SIZE = 32
MAX_CODERS = 64


def encode_number(value: int) -> bytes:
    for n in range(8):
        if value < 1 << (7 * n + 7):
            head = (0xFF << (8 - n)) & 0xFF | value >> (8 * n)
            return bytes([head]) + (value & (1 << 8 * n) - 1).to_bytes(n, "little")
    return b"\xff" + value.to_bytes(8, "little")


class Reader:
    """Cursor over header bytes; running past the end is a parse error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ArchiveError("Parse", "the header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first = self.byte()
        n = 8 - (first ^ 0xFF).bit_length()
        low = int.from_bytes(self.take(n), "little")
        return low | (first & (0x7F >> n)) << (8 * n) if n < 8 else low

    def count(self) -> int:
        n = self.number()
        if n > len(self.data) * 8 + 8:
            raise ArchiveError("Parse", "a count larger than the header")
        return n

    def bits(self, n: int) -> list[bool]:
        data = self.take(-(-n // 8))
        return [bool(data[k // 8] & 0x80 >> k % 8) for k in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if x else None for x in self.defined(n)]


def _folder(r: Reader) -> dict:
    coders, total_in, total_out = [], 0, 0
    n = r.number()
    if not 0 < n <= MAX_CODERS:
        raise ArchiveError("InvalidFolderGraph", f"{n} coders")
    for _ in range(n):
        flags = r.byte()
        code = r.take(flags & 0x0F)
        n_in, n_out = (r.number(), r.number()) if flags & 0x10 else (1, 1)
        props = r.take(r.number()) if flags & 0x20 else None
        if flags & 0xC0 or n_in > MAX_CODERS or n_out != 1:
            raise ArchiveError("InvalidFolderGraph", "coder with reserved flags or several outputs")
        coders.append({"method_id": code.hex().upper(), "num_in": n_in, "num_out": n_out, "properties": props})
        total_in, total_out = total_in + n_in, total_out + n_out
    binds = [{"input": r.number(), "output": r.number()} for _ in range(total_out - 1)]
    n_packed = total_in - len(binds)
    free = [k for k in range(total_in) if k not in {b["input"] for b in binds}]
    packed = free if n_packed == 1 else [r.number() for _ in range(n_packed)]
    if sorted(packed) != free or len({b["output"] for b in binds}) != len(binds) or any(b["output"] >= total_out for b in binds):
        raise ArchiveError("InvalidFolderGraph", "streams are bound twice or not at all")
    return {"coders": coders, "bind_pairs": binds, "packed_indices": packed}


def _streams(r: Reader) -> dict:
    out = {"pack_pos": 0, "pack_sizes": [], "pack_crcs": [], "folders": [], "streams": [], "sizes": [], "crcs": []}
    kind = r.byte()
    if kind == PACK_INFO:
        out["pack_pos"], n = r.number(), r.count()
        out["pack_crcs"] = [None] * n
        while (kind := r.byte()) != END:
            if kind == SIZE:
                out["pack_sizes"] = [r.number() for _ in range(n)]
            elif kind == CRC:
                out["pack_crcs"] = r.digests(n)
            else:
                raise ArchiveError("Parse", "unknown packed-stream property")
        kind = r.byte()
    if kind == UNPACK_INFO:
        if r.byte() != FOLDER:
            raise ArchiveError("Parse", "folders expected")
        n = r.count()
        if r.byte():
            raise ArchiveError("Parse", "external folder definitions")
        folders = [_folder(r) for _ in range(n)]
        if r.byte() != CODER_SIZES:
            raise ArchiveError("Parse", "coder sizes expected")
        for f in folders:
            f["coder_sizes"] = [r.number() for _ in f["coders"]]
            bound = {b["output"] for b in f["bind_pairs"]}
            final = [k for k in range(len(f["coders"])) if k not in bound]
            f["unpack_size"], f["crc"] = f["coder_sizes"][final[0]], None
        while (kind := r.byte()) != END:
            if kind != CRC:
                raise ArchiveError("Parse", "unknown folder property")
            for f, crc in zip(folders, r.digests(n), strict=True):
                f["crc"] = crc
        out["folders"] = folders
        kind = r.byte()
    out["streams"] = [1] * len(out["folders"])
    explicit, digests = None, None
    if kind == SUBSTREAMS:
        kind = r.byte()
        if kind == NUM_STREAMS:
            out["streams"] = [r.count() for _ in out["folders"]]
            kind = r.byte()
        if kind == SIZE:
            explicit = [[r.number() for _ in range(max(n - 1, 0))] for n in out["streams"]]
            kind = r.byte()
        if kind == CRC:
            digests = r.digests(sum(n for n, f in zip(out["streams"], out["folders"], strict=True) if n != 1 or f["crc"] is None))
            kind = r.byte()
        if kind != END:
            raise ArchiveError("Parse", "substreams don't end")
        kind = r.byte()
    if kind != END:
        raise ArchiveError("Parse", "streams don't end")
    # sizes that are told; the last of each folder follows from the folder's
    out["sizes"] = explicit if explicit is not None else [[] for _ in out["folders"]]
    known = iter(digests or [])
    out["crcs"] = [[f["crc"]] if n == 1 and f["crc"] is not None else [next(known, None) for _ in range(n)] for n, f in zip(out["streams"], out["folders"], strict=True)]
    return out


def _external(r: Reader) -> None:
    if r.byte():
        raise ArchiveError("Parse", "external file properties")


def _names(text: bytes, n: int) -> list[bytes]:
    """n names of 16-bit units, each ended by a zero unit."""
    zeros = np.flatnonzero(np.frombuffer(text[: len(text) // 2 * 2], "<u2") == 0) * 2
    if len(zeros) < n:
        raise ArchiveError("Parse", "names end early")
    starts = [0, *(zeros[:n] + 2).tolist()]
    return [text[a:b] for a, b in zip(starts, zeros[:n].tolist(), strict=False)]


def _files(r: Reader) -> tuple[list[dict], list[bool], list[bool]]:
    n = r.count()
    columns: dict[str, list] = {}
    while (kind := r.number()) != END:
        size = r.number()
        p = Reader(r.take(size))
        names = {EMPTY_STREAM: "empty_stream", EMPTY_FILE: "empty_file", ANTI: "anti", NAMES: "raw_name", CTIME: "ctime", ATIME: "atime", MTIME: "mtime", ATTRIBUTES: "attributes", START_POS: "start_pos"}
        name = names.get(kind)
        if name is None:
            continue
        if name in columns:
            raise ArchiveError("Parse", f"{name} given twice")
        if kind == EMPTY_STREAM:
            columns[name] = p.bits(n)
        elif kind in (EMPTY_FILE, ANTI):  # one bit for each entry without a stream
            columns[name] = p.bits(sum(columns.get("empty_stream", [])))
        elif kind == NAMES:
            _external(p)
            columns[name] = _names(p.data[p.at :], n)
        else:
            defined = p.defined(n)
            _external(p)
            width = 4 if kind == ATTRIBUTES else 8
            columns[name] = [int.from_bytes(p.take(width), "little") if x else None for x in defined]
    get = lambda name, k: columns[name][k] if name in columns else None
    return [
        {"entry_index": k, "raw_name": get("raw_name", k), "empty_stream": bool(get("empty_stream", k)), **{x: get(x, k) for x in ("ctime", "atime", "mtime", "attributes", "start_pos")}} for k in range(n)
    ], columns.get("empty_file", []), columns.get("anti", [])


class OutsideCut(Exception):
    """Bytes were asked for that a ``Cut`` leaves out."""


class Cut:
    """An archive of ``size`` bytes of which only the first ones and those from ``at`` on are here; others can't be read."""

    def __init__(self, start: bytes, at: int, tail: bytes, size: int):
        self.start, self.at, self.tail, self.size = start, at, tail, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place: int | slice) -> int | bytes:
        if isinstance(place, int):
            return self[place : place + 1][0]
        a, b, _ = place.indices(self.size)
        if a >= b or b <= len(self.start):
            return self.start[a:b]
        if a < self.at:
            raise OutsideCut
        return self.tail[a - self.at : b - self.at]

    def find(self, what: bytes, *limits: int) -> int:
        return self.start.find(what, *limits)


def find_signature(data: bytes | Cut, limit: int) -> int:
    """Place of the first signature with a valid start header in the first ``limit`` bytes."""
    at, damaged = data.find(MAGIC, 0, limit + len(MAGIC)), False
    while at >= 0:
        if len(data) >= at + SIGNATURE_SIZE and zlib.crc32(data[at + 12 : at + 32]) == struct.unpack("<I", data[at + 8 : at + 12])[0]:
            return at
        damaged = True
        at = data.find(MAGIC, at + 1, limit + len(MAGIC))
    raise ArchiveError("Crc" if damaged else "Parse", "no valid signature header")


#: Fixed value: the method id of encryption.
AES = "06F10701"


def _encoded(r: Reader, data: bytes | Cut, body: int) -> dict:
    """The one folder that holds a packed header, with its packed bytes."""
    enc = _streams(r)
    if len(enc["folders"]) != 1 or len(enc["pack_sizes"]) != 1:
        raise ArchiveError("Parse", "an encoded header has one stream")
    start = body + enc["pack_pos"]
    return enc["folders"][0] | {"bytes": data[start : start + enc["pack_sizes"][0]]}


def outer_header(data: bytes | Cut, scan: int = 1 << 20) -> tuple[dict, bytes, dict | None]:
    """What stands outside a packed header: the signature header, the bytes it points to, and the folder they describe."""
    base = find_signature(data, scan)
    major, minor = data[base + 6], data[base + 7]
    offset, size, crc = struct.unpack("<QQI", data[base + 12 : base + 32])
    body = base + SIGNATURE_SIZE
    if body + offset + size > len(data):
        raise ArchiveError("Parse", "the header lies beyond the end")
    raw = data[body + offset : body + offset + size]
    if zlib.crc32(raw) != crc:
        raise ArchiveError("Crc", "header")
    mode = "Empty" if not size else "Encoded" if raw[0] == ENCODED_HEADER else "Plain"
    out = {"base_offset": base, "major_version": major, "minor_version": minor, "next_header_offset": offset, "next_header_size": size, "header_mode": mode, "header_coders": []}
    if mode != "Encoded":
        return out, raw, None
    folder = _encoded(Reader(raw[1:]), data, body)
    return out | {"header_coders": folder["coders"]}, raw, folder


def _unpacked(folder: dict, sealed: bytes | None) -> bytes:
    """A header out of its folder; ``sealed`` are the bytes that its encryption gives, which Spark has undone."""
    coders, data = folder["coders"], folder["bytes"]
    if any(c["method_id"] == AES for c in coders):
        if sealed is None:
            raise ArchiveError("PasswordRequired", "encrypted header")
        coders, data = [c | {"method_id": "00"} if c["method_id"] == AES else c for c in coders], sealed
    raw = decode_folder(coders, folder["bind_pairs"], folder["coder_sizes"], data, folder["unpack_size"])
    if folder["crc"] is not None and zlib.crc32(raw) != folder["crc"]:
        raise ArchiveError("Crc", "encoded header")
    return raw


def parse_archive(data: bytes | Cut, scan: int = 1 << 20, sealed: bytes | None = None) -> dict:
    """Everything the headers of one archive say, as nested rows; an error tells what stands outside a packed header."""
    out, raw, folder = outer_header(data, scan)
    try:
        if folder is not None:
            raw = _unpacked(folder, sealed)
        return out | _inner(raw, data, out["base_offset"] + SIGNATURE_SIZE)
    except ArchiveError as e:
        e.outer = out
        raise


def _inner(raw: bytes, data: bytes | Cut, body: int) -> dict:
    streams, files, empty_file, anti = _streams(Reader(bytes([END]))), [], [], []
    while raw:
        r = Reader(raw)
        kind = r.byte()
        if kind == ENCODED_HEADER:
            raw = _unpacked(_encoded(r, data, body), None)
            continue
        if kind != HEADER:
            raise ArchiveError("Parse", "neither a header nor an encoded one")
        while (kind := r.byte()) != END:
            if kind == ARCHIVE_PROPERTIES:
                while r.number() != END:
                    r.take(r.number())
            elif kind == MAIN_STREAMS:
                streams = _streams(r)
            elif kind == FILES:
                files, empty_file, anti = _files(r)
            else:
                raise ArchiveError("Parse", f"section {kind:#x}")
        break
    at = 0
    for f, n, sizes, crcs in zip(streams["folders"], streams["streams"], streams["sizes"], streams["crcs"], strict=True):
        k = len(f["packed_indices"])
        own = slice(at, at + k)
        f["packed"] = [{"size": s, "crc": c} for s, c in zip(streams["pack_sizes"][own], streams["pack_crcs"][own], strict=True)]
        if len(f["packed"]) != k:
            raise ArchiveError("Parse", "too few packed streams")
        at += k
        f |= {"num_substreams": n, "sizes": sizes, "crcs": crcs}
    return {"pack_pos": streams["pack_pos"], "pack_total": sum(streams["pack_sizes"]), "folders": streams["folders"], "files": files, "empty_file": empty_file, "anti": anti}


# ---- writing -----------------------------------------------------------------------------------


def _bitmap(values: list[bool]) -> bytes:
    out = bytearray(-(-len(values) // 8))
    for k, x in enumerate(values):
        out[k // 8] |= bool(x) * (0x80 >> k % 8)
    return bytes(out)


def _property(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + encode_number(len(body)) + body


def _numbers(values: list[int | None], width: int) -> bytes:
    known = [x is not None for x in values]
    head = b"\x01" if all(known) else b"\x00" + _bitmap(known)
    return head + b"\x00" + b"".join(x.to_bytes(width, "little") for x in values if x is not None)


def _coder(coder: dict) -> bytes:
    code, props, n_in = bytes.fromhex(coder["method_id"]), coder["properties"], coder.get("num_in", 1)
    inputs = encode_number(n_in) + encode_number(1) if n_in != 1 else b""
    return bytes([len(code) | 0x10 * bool(inputs) | 0x20 * bool(props)]) + code + inputs + (encode_number(len(props)) + bytes(props) if props else b"")


def _folder_bytes(coders: list[dict], binds: list[tuple[int, int]] | None = None, packed_indices: list[int] | None = None) -> bytes:
    """Coders and how they are bound, as (input, output); without that a chain: each coder's input is the next one's output."""
    binds = [(k, k + 1) for k in range(len(coders) - 1)] if binds is None else binds
    out = encode_number(len(coders)) + b"".join(map(_coder, coders)) + b"".join(encode_number(i) + encode_number(o) for i, o in binds)
    return out + (b"".join(map(encode_number, packed_indices)) if packed_indices and len(packed_indices) > 1 else b"")


def _digests(crcs: list[int | None]) -> bytes:
    known = [x is not None for x in crcs]
    return (b"\x01" if all(known) else b"\x00" + _bitmap(known)) + b"".join(struct.pack("<I", x) for x in crcs if x is not None)


def _pack_info(pos: int, sizes: list[int], crcs: list[int | None] = ()) -> bytes:
    checks = bytes([CRC]) + _digests(crcs) if any(x is not None for x in crcs) else b""
    return bytes([PACK_INFO]) + encode_number(pos) + encode_number(len(sizes)) + bytes([SIZE]) + b"".join(map(encode_number, sizes)) + checks + bytes([END])


def build_header(folders: list[dict], files: list[dict]) -> bytes:
    """A plain header. Folders: coders, coder_sizes, packed_sizes, sizes, crcs, and where they have them crc, packed_crcs,
    binds, packed_indices; files: raw_name, empty_stream, empty_file, anti, ctime, atime, mtime, attributes."""
    out = bytes([HEADER])
    if folders:
        out += bytes([MAIN_STREAMS]) + _pack_info(0, [x for f in folders for x in f["packed_sizes"]], [x for f in folders for x in f.get("packed_crcs") or [None] * len(f["packed_sizes"])])
        out += bytes([UNPACK_INFO, FOLDER]) + encode_number(len(folders)) + b"\x00" + b"".join(_folder_bytes(f["coders"], f.get("binds"), f.get("packed_indices")) for f in folders)
        out += bytes([CODER_SIZES]) + b"".join(encode_number(x) for f in folders for x in f["coder_sizes"])
        if any(f.get("crc") is not None for f in folders):
            out += bytes([CRC]) + _digests([f.get("crc") for f in folders])
        out += bytes([END, SUBSTREAMS])
        if any(len(f["sizes"]) != 1 for f in folders):
            out += bytes([NUM_STREAMS]) + b"".join(encode_number(len(f["sizes"])) for f in folders)
        if any(len(f["sizes"]) > 1 for f in folders):
            out += bytes([SIZE]) + b"".join(encode_number(x) for f in folders for x in f["sizes"][:-1])
        crcs = [c for f in folders if len(f["sizes"]) != 1 or f.get("crc") is None for c in f["crcs"]]
        if crcs:
            out += bytes([CRC]) + _digests(crcs)
        out += bytes([END, END])
    if files:
        out += bytes([FILES]) + encode_number(len(files))
        empty = [f for f in files if f["empty_stream"]]
        if empty:
            out += _property(EMPTY_STREAM, _bitmap([f["empty_stream"] for f in files]))
            for kind, name in ((EMPTY_FILE, "empty_file"), (ANTI, "anti")):
                if any(f.get(name) for f in empty):
                    out += _property(kind, _bitmap([f.get(name) for f in empty]))
        out += _property(NAMES, b"\x00" + b"".join(bytes(f["raw_name"]) + b"\0\0" for f in files))
        for kind, name, width in ((CTIME, "ctime", 8), (ATIME, "atime", 8), (MTIME, "mtime", 8), (ATTRIBUTES, "attributes", 4)):
            values = [f.get(name) for f in files]
            if any(x is not None for x in values):
                out += _property(kind, _numbers(values, width))
        out += bytes([END])
    return out + bytes([END])


def encoded_header(size: int, crc: int, packed_size: int, pos: int, coders: list[dict], coder_sizes: list[int]) -> bytes:
    """The short header that tells where the packed form of the plain one lies, and by which chain of coders it was packed."""
    out = bytes([ENCODED_HEADER]) + _pack_info(pos, [packed_size])
    out += bytes([UNPACK_INFO, FOLDER]) + encode_number(1) + b"\x00" + _folder_bytes(coders)
    return out + bytes([CODER_SIZES]) + b"".join(map(encode_number, coder_sizes)) + bytes([CRC, 1]) + struct.pack("<I", crc) + bytes([END, END])


def signature_header(offset: int, header: bytes) -> bytes:
    start = struct.pack("<QQI", offset, len(header), zlib.crc32(header))
    return MAGIC + b"\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start
