"""Substring dedup by difference-cover anchors.

A window is a run of ``min_words`` consecutive words of one document. A window is a copy if the same
words also start earlier: in a document with a smaller ``doc_id``, or earlier in the same one. Every
word that a copy covers is removed; windows are judged on the input.

Let D be a difference cover of the residues modulo v: for any two positions i and j there is a k < v
with both i + k and j + k in D (modulo v). Then two equal windows share an anchor, a run of
``min_words - v + 1`` words that stands at a position of D in both. So

1. only anchors at positions of D are hashed and dealt out by hash; those that occur twice return to
   their blocks (an anchor occurs once per block at most, however many copies a block holds);
2. around each such anchor the match is extended: the full windows that hold it are hashed with 128
   bits and dealt out, with each block's first occurrence; the owner of a window is the first of all;
3. blocks learn which of their windows are owned elsewhere, and cut the covered words out.

A block is a hash range of doc_id with about 4 MB of text, a bucket a hash range of anchors with about
a million of them; the number of both follows the size of the input. Texts are shuffled once (the
exchange by block is the same in all three steps), hashes twice. No pairs are ever formed, so a passage
that a third of all documents share costs one entry per block.

Cases: null, empty and blank texts have no words and stay (null kept text becomes empty); texts shorter
than a window keep all words; rows that repeat a doc_id are the same document for the order, so equal
rows judge alike; null doc_id counts as the smallest; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PLAIN, column_bytes, mask_to_spans, runs_of_texts, spans_to_mask, text_size, window_hash

#: Perfect difference sets, each a difference cover of its period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

BLOCK_BYTES = 4 << 20
BUCKET_ANCHORS = 1 << 20
_FIRST = np.iinfo(np.int64).min

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def period_for(min_words: int) -> int:
    """The largest known period that still leaves anchors of a third of a window; 1 for the shortest windows."""
    fit = [v for v in COVERS if 3 * (min_words - v + 1) >= min_words]
    return max(fit, default=1)


def _bytes(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def _parts(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, from its upper half, which orders alike in every block."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_FIRST).to_numpy()


class _Block:
    """Words of a block's texts, run by run of a few MB."""

    def __init__(self, table: pa.Table):
        self.ids = _doc_ids(table)
        self.data, self.offsets = column_bytes(table.column("text"))

    def runs(self):
        for a, b in runs_of_texts(self.offsets):
            words, starts, ends, firsts = PLAIN.cut(self.data, self.offsets[a : b + 1])
            yield a, b, words, starts, ends, firsts


def _within(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its position in its text, and whether a run of ``size`` words starts there."""
    n = int(firsts[-1])
    lengths = np.diff(firsts)
    pos = np.arange(n) - np.repeat(firsts[:-1], lengths)
    return pos, pos + size <= np.repeat(lengths, lengths)


def _anchors(words, firsts, period, size):
    """Number of the first word and hash of each anchor."""
    pos, whole = _within(firsts, size)
    at = np.flatnonzero(whole & np.isin(pos % period, COVERS.get(period, (0,))))
    return at, window_hash(words, size)[at] if len(at) else np.zeros(0, np.uint64)


def _ask_anchors(n_buckets: int, period: int, size: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = [_anchors(w, f, period, size)[1] for _, _, w, _, _, f in _Block(table).runs()]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        many = (counts > 1).astype(np.uint8)
        edges = np.searchsorted(_parts(hashes, n_buckets), np.arange(n_buckets + 1))
        rows = [k for k in range(n_buckets) if edges[k] < edges[k + 1]]
        data = [_bytes(hashes[edges[k] : edges[k + 1]], many[edges[k] : edges[k + 1]]) for k in rows]
        return pa.table({"bucket": rows, "block": [block] * len(rows), "data": data}, schema)

    return ask


_ANSWER = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def _gathered(table: pa.Table, width: int):
    """Blobs of a bucket as one array of entries with the ordinal of the block; blobs hold columns of 8 bytes, and with an odd width one of 1."""
    blocks, sizes, columns = [], [], None
    for block, blob in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        n = len(blob) // width
        parts = [np.frombuffer(blob, np.uint64, n, 8 * n * k) for k in range(width // 8)]
        if width % 8:
            parts.append(np.frombuffer(blob, np.uint8, n, 8 * n * (width // 8)))
        columns = columns or [[] for _ in parts]
        for c, x in zip(columns, parts, strict=True):
            c.append(x)
        blocks.append(block)
        sizes.append(n)
    return np.array(blocks, np.int64), np.repeat(np.arange(len(blocks)), sizes), [np.concatenate(c) for c in columns]


def _answers(blocks: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> pa.Table:
    order = np.argsort(of, kind="stable")
    of, hashes = of[order], hashes[order]
    edges = np.searchsorted(of, np.arange(len(blocks) + 1))
    rows = [k for k in range(len(blocks)) if edges[k] < edges[k + 1]]
    return pa.table({"block": blocks[rows], "data": [_bytes(hashes[edges[k] : edges[k + 1]]) for k in rows]}, _ANSWER)


def _repeated_anchors(table: pa.Table) -> pa.Table:
    blocks, of, (hashes, many) = _gathered(table, 9)
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    same = own[1:] == own[:-1]
    twice = many[order] > 0
    twice[1:] |= same
    twice[:-1] |= same
    # an anchor that one block has many times is told to all blocks by its being there twice
    return _answers(blocks, of[order][twice], own[twice])


def _held(table: pa.Table) -> np.ndarray:
    blobs = table.column("data").to_pylist()
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])) if blobs else np.zeros(0, np.uint64)


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _ask_windows(n_buckets: int, period: int, size: int, window: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def ask(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        repeated = _held(answers)
        found = []
        if len(repeated) and len(table):
            block = _Block(table)
            for a, _, words, _, _, firsts in block.runs():
                at, hashes = _anchors(words, firsts, period, size)
                at = at[_in_sorted(hashes, repeated)]
                pos, whole = _within(firsts, window)
                start = np.flatnonzero(whole)  # extend: windows that hold a repeated anchor
                start = start[np.searchsorted(at, start + period, "left") > np.searchsorted(at, start, "left")]
                if len(start):
                    doc = block.ids[a + np.searchsorted(firsts, start, "right") - 1]
                    found.append((window_hash(words, window)[start], window_hash(words, window, 1)[start], doc.view(np.uint64), pos[start].astype(np.uint64)))
        if not found:
            return schema.empty_table()
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.lexsort((columns[3], columns[2].view(np.int64), columns[1], columns[0]))
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        columns = [c[new] for c in columns]
        edges = np.searchsorted(_parts(columns[0], n_buckets), np.arange(n_buckets + 1))
        rows = [k for k in range(n_buckets) if edges[k] < edges[k + 1]]
        data = [_bytes(*(c[edges[k] : edges[k + 1]] for c in columns)) for k in rows]
        return pa.table({"bucket": rows, "block": [key[0].as_py()] * len(rows), "data": data}, schema)

    return ask


def _owned_elsewhere(table: pa.Table) -> pa.Table:
    """To each block those of its windows that start earlier in another block."""
    blocks, of, (one, two, doc, pos) = _gathered(table, 32)
    order = np.lexsort((pos, doc.view(np.int64), two, one))
    one, two, of = one[order], two[order], of[order]
    later = np.zeros(len(one), bool)
    later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    # equal ids and positions in two blocks cannot be: a doc_id has one block
    return _answers(blocks, of[later], mix2(one[later], two[later]))


def mix2(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """64 bits of a 128-bit window hash; enough inside one block."""
    with np.errstate(over="ignore"):
        return one * np.uint64(0x9E3779B97F4A7C15) ^ two


def _cut_out(window: int, layout: str):
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", struct), ("kept_text", pa.string())])

    def cut(key: tuple[pa.Scalar], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        elsewhere = _held(answers)
        block = _Block(table)
        runs, hashes, docs, places = [], [], [], []
        for a, b, words, starts, ends, firsts in block.runs():
            pos, whole = _within(firsts, window)
            start = np.flatnonzero(whole)
            runs.append((a, b, starts, ends, firsts, start))
            if len(start):
                hashes.append(mix2(window_hash(words, window)[start], window_hash(words, window, 1)[start]))
                docs.append(block.ids[a + np.searchsorted(firsts, start, "right") - 1])
                places.append(pos[start])
        copies = np.zeros(0, bool)
        if hashes:
            hashes, docs, places = map(np.concatenate, (hashes, docs, places))
            order = np.argsort(hashes, kind="stable")
            sorted_ = hashes[order]
            same = sorted_[1:] == sorted_[:-1]
            copies = _in_sorted(hashes, elsewhere)
            if same.any():  # repeated inside the block: all but the first occurrence
                group = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                some = order[group]
                some = some[np.lexsort((places[some], docs[some], hashes[some]))]
                h, d, p = hashes[some], docs[some], places[some]
                head = np.concatenate([[True], h[1:] != h[:-1]])
                lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
                copies[some] |= (d != d[lead]) | (p != p[lead])
        out_words, out_removed, out_spans, out_text, used = [], [], [], [], 0
        for a, b, starts, ends, firsts, start in runs:
            mine = copies[used : used + len(start)]
            used += len(start)
            gone = spans_to_mask(start[mine], window, int(firsts[-1]))
            for k in range(b - a):
                i, j = int(firsts[k]), int(firsts[k + 1])
                out_words.append(j - i)
                lo, hi = mask_to_spans(gone[i:j])
                out_removed.append(int((hi - lo).sum()))
                out_spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                raw = block.data[block.offsets[a + k] : block.offsets[a + k + 1]].tobytes()
                if not len(lo):
                    out_text.append(raw if layout == "lines" else b" ".join(raw.split()))
                    continue
                base = int(block.offsets[a + k])
                keep_lo, keep_hi = np.concatenate([[0], hi]), np.concatenate([lo, [j - i]])
                kept = [raw[int(starts[i + x]) - base : int(ends[i + y - 1]) - base] for x, y in zip(keep_lo, keep_hi, strict=True) if x < y]
                out_text.append(b"\n".join(kept) if layout == "lines" else b" ".join(b" ".join(x.split()) for x in kept))
        return pa.table([table.column("doc_id").cast(pa.int64()), pa.array(out_words, pa.int64()), pa.array(out_removed, pa.int64()), pa.array(out_spans, struct), pa.array(out_text, pa.binary()).cast(pa.string())], schema=schema)

    return cut


def substring_dedup(docs: DataFrame, min_words: int = 20, period: int | None = None, layout: str = "words") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its words, those removed, their spans, and what is kept:
    words joined by one space, or with ``layout`` "lines" the pieces between cuts as they stand, one a line. See the module for the method and the cases."""
    v = period or period_for(min_words)
    size = min_words - v + 1
    if size < 1:
        raise ValueError("the period must not exceed min_words")
    _, n_bytes = text_size(docs)
    n_blocks = max(64, -(-n_bytes // BLOCK_BYTES))
    n_buckets = max(64, int(n_bytes / 6 * len(COVERS.get(v, (0,))) / v) // BUCKET_ANCHORS)
    texts = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ask = "bucket long, block long, data binary"
    answer = "block long, data binary"
    by_block = texts.groupBy("block")
    anchors = by_block.applyInArrow(_ask_anchors(n_buckets, v, size), ask).groupBy("bucket").applyInArrow(_repeated_anchors, answer)
    windows = by_block.cogroup(anchors.groupBy("block")).applyInArrow(_ask_windows(n_buckets, v, size, min_words), ask)
    elsewhere = windows.groupBy("bucket").applyInArrow(_owned_elsewhere, answer)
    return by_block.cogroup(elsewhere.groupBy("block")).applyInArrow(_cut_out(min_words, layout), RESULT)
