"""Coders of a block, with the codecs of the standard library; each task decodes or encodes whole blocks."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import numpy as np


class ArchiveError(Exception):
    """A failure with a code, so that it can be a row."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


#: Branch filters of the archive format by method id.
BRANCH = {"03030103": lzma.FILTER_X86, "03030501": lzma.FILTER_ARM, "03030701": lzma.FILTER_ARMTHUMB, "03030401": lzma.FILTER_IA64, "03030205": lzma.FILTER_POWERPC, "03030805": lzma.FILTER_SPARC}
MAX_DICTIONARY = 256 << 20

#: Dictionary size and search length of the compression levels.
LEVELS = {1: (256 << 10, 32), 3: (4 << 20, 32), 5: (16 << 20, 32), 7: (32 << 20, 64), 9: (64 << 20, 64)}


def _lzma_filter(method: str, props: bytes | None) -> dict:
    props = bytes(props or b"")
    if method == "030101":
        if len(props) != 5 or props[0] >= 225:
            raise ArchiveError("Decompression", "LZMA properties")
        size = struct.unpack_from("<I", props, 1)[0]
        spec = {"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": props[0] % 9, "lp": props[0] // 9 % 5, "pb": props[0] // 45}
    else:
        if len(props) != 1 or props[0] >= 40:
            raise ArchiveError("Decompression", "LZMA2 properties")
        size = (2 | props[0] & 1) << (props[0] // 2 + 11)
        spec = {"id": lzma.FILTER_LZMA2, "dict_size": size}
    if size > MAX_DICTIONARY:
        raise ArchiveError("ResourceLimitExceeded", f"dictionary of {size} bytes")
    return spec


def _raw(filters: list[dict], data: bytes, size: int) -> bytes:
    try:
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)
    except lzma.LZMAError as e:
        raise ArchiveError("Decompression", str(e)) from e


def _decode(method: str, props: bytes | None, data: bytes, size: int) -> bytes:
    try:
        if method == "00":
            return data
        if method in ("030101", "21"):
            return _raw([_lzma_filter(method, props)], data, size)
        if method == "040108":
            return zlib.decompressobj(-15).decompress(data, size)
        if method == "040202":
            return bz2.BZ2Decompressor().decompress(data, size)
        if method == "03":
            step = (props or b"\0")[0] + 1
            lanes = np.frombuffer(data + bytes(-len(data) % step), np.uint8).reshape(-1, step)
            return np.cumsum(lanes, axis=0, dtype=np.uint8).tobytes()[: len(data)]
        if method in ("020302", "020304"):
            return _swapped(data, 2 if method == "020302" else 4)
    except (zlib.error, OSError, ValueError, EOFError) as e:
        raise ArchiveError("Decompression", str(e)) from e
    raise ArchiveError("UnsupportedCodec", method)


def decode_folder(coders: list[dict], bind_pairs: list[dict], sizes: list[int], packed: bytes, unpack_size: int) -> bytes:
    """Bytes of a block whose coders form a chain, checked for their declared size."""
    if any(c["num_in"] != 1 for c in coders):
        raise ArchiveError("UnsupportedCodec", "a coder with several inputs")
    feeds = {b["input"]: b["output"] for b in bind_pairs}  # a coder's input is another one's output
    order = [next(k for k in range(len(coders)) if k not in feeds.values())]
    while order[-1] in feeds:
        order.append(feeds[order[-1]])
    if len(order) != len(coders):
        raise ArchiveError("InvalidFolderGraph", "coders that nothing reads")
    data, k = packed, len(order) - 1
    while k >= 0:
        c = coders[order[k]]
        size = sizes[order[k]]
        filters: list[dict] = []
        if c["method_id"] in ("030101", "21"):  # branch filters run inside the same decoder
            filters = [_lzma_filter(c["method_id"], c["properties"])]
            while k > 0 and coders[order[k - 1]]["method_id"] in BRANCH:
                k -= 1
                filters.insert(0, {"id": BRANCH[coders[order[k]]["method_id"]]})
                size = sizes[order[k]]
            data = _raw(filters, data, size)
        else:
            data = _decode(c["method_id"], c["properties"], data, size)
        if len(data) != size:
            raise ArchiveError("Decompression", f"{len(data)} bytes for {size}")
        k -= 1
    if len(data) != unpack_size:
        raise ArchiveError("Decompression", "block size")
    return data


#: Names of filters by method id, as packing takes them.
FILTERS = {"bcj": "03030103", "arm": "03030501", "armt": "03030701", "ia64": "03030401", "ppc": "03030205", "sparc": "03030805", "swap2": "020302", "swap4": "020304"}


def _swapped(data: bytes, width: int) -> bytes:
    whole = len(data) // width * width
    return np.frombuffer(data[:whole], f"u{width}").byteswap().tobytes() + data[whole:]


def _filtered(data: bytes, name: str) -> tuple[bytes, dict, list[dict]]:
    """Data through a filter that stands before any codec, its coder; or, for branch filters, what goes into the codec's own chain."""
    coder = {"method_id": FILTERS.get(name, "03"), "num_in": 1, "num_out": 1, "properties": None}
    if name.startswith("delta"):
        step = int(name[5:] or 1)
        lanes = np.frombuffer(data + bytes(-len(data) % step), np.uint8).reshape(-1, step)
        return np.diff(lanes, axis=0, prepend=np.zeros((1, step), np.uint8)).tobytes()[: len(data)], coder | {"properties": bytes([step - 1])}, []
    if name in ("swap2", "swap4"):
        return _swapped(data, int(name[4:])), coder, []
    return data, coder, [{"id": BRANCH[coder["method_id"]]}]


def known_filter(name: str) -> bool:
    return name in FILTERS or name[:5] == "delta" and (not name[5:] or name[5:].isdecimal() and 1 <= int(name[5:]) <= 256)


def encode_block(data: bytes, codec: str, level: int = 5, bcj: bool = False, filter_: str | None = None) -> tuple[bytes, list[dict]]:
    """Packed bytes and coders of a block; a filter (``bcj``, ``delta4``, ``arm``, ...) goes before the codec. Branch filters
    run inside the encoder of LZMA2."""
    if level not in LEVELS and codec not in ("copy", "deflate", "bzip2"):
        raise ArchiveError("InvalidOptions", f"level {level}")
    one = lambda code, props=None: {"method_id": code, "num_in": 1, "num_out": 1, "properties": props}
    filter_ = "bcj" if bcj else filter_
    if filter_ and not known_filter(filter_):
        raise ArchiveError("InvalidOptions", f"filter {filter_}")
    data, first, branch = _filtered(data, filter_) if filter_ else (data, None, [])
    before = [first] if first else []
    if branch and codec != "lzma2":
        raise ArchiveError("InvalidOptions", "branch filters go with LZMA2 only")
    if codec == "copy":
        return data, [*before, one("00")]
    if codec == "deflate":
        z = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
        return z.compress(data) + z.flush(), [*before, one("040108")]
    if codec == "bzip2":
        return bz2.compress(data, min(max(level, 1), 9)), [*before, one("040202")]
    size, nice = LEVELS.get(level, LEVELS[5])
    if codec == "lzma":
        spec = {"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2, "nice_len": nice, "mode": lzma.MODE_NORMAL if level >= 5 else lzma.MODE_FAST}
        return lzma.compress(data, lzma.FORMAT_RAW, filters=[spec]), [*before, one("030101", bytes([3 + 9 * (0 + 5 * 2)]) + struct.pack("<I", size))]
    if codec == "lzma2":
        prop = next(p for p in range(40) if (2 | p & 1) << (p // 2 + 11) >= size)
        filters = [*branch, {"id": lzma.FILTER_LZMA2, "dict_size": size, "nice_len": nice, "mode": lzma.MODE_NORMAL if level >= 5 else lzma.MODE_FAST}]
        return lzma.compress(data, lzma.FORMAT_RAW, filters=filters), [*before, one("21", bytes([prop]))]
    raise ArchiveError("UnsupportedCodec", codec)
