"""What the corpus operators share: word hashes over Arrow buffers, sizes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, release, remove, scratch, shared_dir

#: Separators of words by white space, as a character class of Java's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that are hashed at once; longer texts are hashed piece by piece.
PIECE = 1 << 20

_U = np.uint64


def text_size(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text; what decides how many blocks and buckets a job is cut into."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def word_count(text):
    """Native count of words by white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- word hashes -----------------------------------------------------------------------------


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer of a 64-bit hash (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        z = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


_BASE = 0x5851F42D4C957F2D  # odd, 5 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)])


class Words:
    """How texts are cut into words: which bytes separate, and whether A-Z become a-z first."""

    def __init__(self, separators: bytes, lower: bool):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.sep = self.sep[fold]
        self.fold = fold.astype(np.uint8)
        self.value = _BYTE[fold]

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that stand in ``data`` at ``offsets``: hash, first byte and end of each word, and the
        number of each text's first word (one more entry than texts)."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        sep = self.sep[data[lo:hi]]
        n = hi - lo
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cuts = (offsets - lo).astype(np.int64)
        inner = cuts[(cuts > 0) & (cuts < n)]
        word = ~sep
        first = word.copy()
        first[1:] &= sep[:-1]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= sep[1:]
        last[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        del first, last, word, sep
        hashes = np.empty(len(starts), np.uint64)
        done = 0
        while done < len(starts):
            upto = max(done + 1, int(np.searchsorted(ends, starts[done] + PIECE, "right")))
            a, b = int(starts[done]), int(ends[upto - 1])
            hashes[done:upto] = self._hash(data[lo + a : lo + b], starts[done:upto] - a, ends[done:upto] - a)
            done = upto
        return hashes, starts + lo, ends + lo, np.searchsorted(starts, cuts)

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        global _POWER, _BACK
        n = len(data)
        if n > len(_POWER):  # one word longer than a piece
            _POWER, _BACK = _powers(_BASE, n), _powers(_INVERSE, n)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[data] * _POWER[:n], out=total[1:])
            return mix((total[ends] - total[starts]) * _BACK[starts] + (ends - starts).astype(np.uint64))


_POWER, _BACK = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    return (_POWER[:n], _BACK[:n]) if n <= PIECE else (_powers(_BASE, n), _powers(_INVERSE, n))

#: Words by white space, unchanged; the same with A-Z as a-z; runs of letters, digits and bytes over 0x7F.
PLAIN = Words(b" \t\n\x0b\x0c\r", lower=False)
FOLDED = Words(b" \t\n\x0b\x0c\r", lower=True)
ALNUM = Words(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def window_hash(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, by its first word; one 64-bit half of it for each salt."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        own = mix(words, 11 + salt)
        base = _U(0x27BB2EE687B0B0FD)
        out = own[:n].copy()
        for k in range(1, size):
            out *= base
            out += own[k : k + n]
    return mix(out, 23 + salt)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if offsets else np.zeros(1, kind)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def runs_of_texts(offsets: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes, so that what is made of them stays small."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def spans_to_mask(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def mask_to_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]
