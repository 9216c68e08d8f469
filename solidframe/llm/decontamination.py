"""Benchmark decontamination by a distributed positional inverted index.

Training texts are cut into shards of a few MB. Each shard stores the postings of its tokens: the sorted
distinct terms (64-bit word hashes) and, term by term, the positions where each stands. The index is
partitioned by document, so building it shuffles nothing, a shard's postings fit in a task however large
the corpus, and it may be written as a table and searched again.

The test items are the stated query set. Their phrases (every run of ``window`` consecutive words; an item
of fewer words is one phrase) are looked up in each shard: lists are intersected from a phrase's rarest
term in that shard to its most frequent, each list shifted by the term's offset in the phrase, so that what
is left are the starts of exact matches. With ``slop`` > 0 a term may stand up to ``slop`` words from its
place (proximity match).

Items go to the tasks in groups of at most ``group_bytes`` of text (what is broadcast is bounded by that
parameter). With one group the postings are made and searched in one pass, and terms that no item has are left
out of them. With more, rows get a key of their own, the index is stored in the shared folder, and each group
searches what is stored: texts are cut and hashed once whatever the number of items. The spans of a row are put
together by its key. An index may also be stored by the caller (``build_postings``) and searched for further
items with ``search_postings``.

Cases: null and blank texts have no words and no hits; items without words match nothing; equal items and
equal rows are each reported; an empty corpus gives an empty result, empty items give no hits; null item
ids are left out of the item list but their matches count; further columns are not read. Rows that repeat
a doc_id are one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, column_bytes, mask_to_spans, materialize, runs_of_texts

POSTINGS = "doc_ids array<long>, firsts binary, terms binary, edges binary, positions binary"
HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])

#: Candidates that are intersected at once.
CANDIDATES = 1 << 20


class Phrases:
    """Distinct phrases of a group of items: for each length the terms, and the items of each phrase."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        column = pa.array([text for _, text in items], pa.large_string())
        words, _, _, firsts = ALNUM.cut(*column_bytes(column))
        found: dict[bytes, set[int]] = {}
        for k in range(len(items)):
            own = words[firsts[k] : firsts[k + 1]]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                found.setdefault(own[i : i + size].tobytes(), set()).add(k)
        self.names = [None if name is None else str(name) for name, _ in items]
        self.terms = np.unique(words)
        self.by_size: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(x) // 8 for x in found}):
            own = [x for x in found if len(x) == 8 * size]
            hashes = np.frombuffer(b"".join(own), np.uint64).reshape(len(own), size)
            self.by_size[size] = np.searchsorted(self.terms, hashes), [sorted(found[x]) for x in own]


class _Terms:
    """Finds words among the terms of the items; most words fall in no slot of the table."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = np.uint64(64 - max(8, int(len(terms) * 16).bit_length()))
        self.slots = np.zeros(1 << int(np.uint64(64) - self.bits), bool)
        self.slots[terms >> self.bits] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and which term each is."""
        at = np.flatnonzero(self.slots[words >> self.bits])
        own = words[at]
        number = np.minimum(np.searchsorted(self.terms, own), max(len(self.terms) - 1, 0))
        real = self.terms[number] == own
        return at[real], number[real]


def _index(terms: _Terms | None):
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("firsts", "terms", "edges", "positions"))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = column_bytes(batch.column("text"))
            for a, b in runs_of_texts(offsets):
                words, _, _, firsts = ALNUM.cut(data, offsets[a : b + 1])
                if terms is None:
                    at = np.argsort(words, kind="stable")
                    own, counts = np.unique(words, return_counts=True)
                elif len(terms.terms):
                    at, number = terms.places(words)
                    at = at[np.argsort(number.astype(np.int32), kind="stable")]
                    counts = np.bincount(number, minlength=len(terms.terms))
                    own, counts = terms.terms[counts > 0], counts[counts > 0]
                else:
                    at, own, counts = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                blobs = [x.tobytes() for x in (firsts.astype(np.int64), own, edges, at.astype(np.int32 if len(words) < 1 << 31 else np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a:b].to_pylist()], schema[0].type), *(pa.array([x], pa.binary()) for x in blobs)], schema=schema
                )

    return index


def build_postings(docs: DataFrame, phrases: Phrases | None = None) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text): one row per shard. With ``phrases``, of their terms only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_index(_Terms(phrases.terms) if phrases else None), POSTINGS)


class _Shard:
    def __init__(self, row: dict):
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.n = int(self.firsts[-1])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.edges = np.frombuffer(row["edges"], np.int64)
        wide = len(row["positions"]) == 8 * int(self.edges[-1]) and self.n >= 1 << 31
        self.positions = np.frombuffer(row["positions"], np.int64 if wide else np.int32).astype(np.int64)
        counts = np.diff(self.edges)
        self.keys = np.repeat(np.arange(len(counts)) * (self.n + 1), counts) + self.positions

    def nearest(self, term: np.ndarray, position: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term stands within ``slop`` words of the position."""
        low = term * (self.n + 1) + np.maximum(position - slop, 0)
        at = np.searchsorted(self.keys, low)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (key <= term * (self.n + 1) + np.minimum(position + slop, self.n - 1)) & (position + slop >= 0)

    def find(self, phrases: np.ndarray, terms: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of the matches of phrases of one length, given by the numbers of their terms."""
        if not len(self.terms) or not len(phrases):
            return
        own = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = np.where(self.terms[own] == terms, own, -1)[phrases]
        possible = np.flatnonzero((here >= 0).all(axis=1))
        if not len(possible):
            return
        here = here[possible]
        size = here.shape[1]
        counts = np.diff(self.edges)[here]
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = np.take_along_axis(here, order[:, :1], 1)[:, 0]
        many = np.cumsum(np.diff(self.edges)[rarest])
        a = 0
        while a < len(possible):
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + CANDIDATES, "right")))
            lengths = np.diff(self.edges)[rarest[a:b]]
            of = np.repeat(np.arange(a, b), lengths)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            start = self.positions[self.edges[rarest[of]] + nth] - order[of, 0]
            for r in range(size):
                if r == 0:  # the whole phrase must lie in one text
                    text = np.searchsorted(self.firsts, start, "right") - 1
                    ok = (start >= 0) & (start + size <= self.firsts[np.clip(text + 1, 0, len(self.firsts) - 1)])
                else:
                    at = order[of, r]
                    ok = self.nearest(here[of, at], start + at, slop)
                of, start = of[ok], start[ok]
                if not len(of):
                    break
            if len(of):
                yield possible[of], start
            a = b


def _search(phrases: Phrases, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                shard = _Shard(row)
                step = np.zeros(shard.n + 1, np.int64)
                hits: set[tuple[int, int]] = set()
                for size, (numbers, owners) in phrases.by_size.items():
                    for found, start in shard.find(numbers, phrases.terms, slop):
                        np.add.at(step, start, 1)
                        np.add.at(step, start + size, -1)
                        text = np.searchsorted(shard.firsts, start, "right") - 1
                        pairs = np.unique(np.stack([text, found]), axis=1)
                        for t, p in pairs.T.tolist():
                            hits.update((t, item) for item in owners[p])
                hit = np.cumsum(step[: shard.n]) > 0
                items: dict[int, list[str]] = {}
                for t, item in hits:
                    if phrases.names[item] is not None:
                        items.setdefault(t, []).append(phrases.names[item])
                any_hit = {t for t, _ in hits}
                spans = []
                for t in range(len(row["doc_ids"])):
                    lo, hi = mask_to_spans(hit[shard.firsts[t] : shard.firsts[t + 1]]) if t in any_hit else ((), ())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(shard.firsts)), pa.array(spans, _SPANS), pa.array([sorted(set(items.get(t, ()))) for t in range(len(spans))], pa.list_(pa.string()))], schema=_HITS
                )

    return search


def search_postings(postings: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Matches of one group of phrases in an index: one row per document row, with spans of words and items."""
    return postings.mapInArrow(_search(phrases, slop), HITS)


def item_groups(items: DataFrame, item_col: str, text_col: str, group_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The query set in groups of at most about ``group_bytes`` of text; a group is all that the driver holds at once."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-2 * int(total) // group_bytes) if total > group_bytes else 1)
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, item_col: str = "item_id", text_col: str = "text", group_bytes: int = 4 << 20
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, spans of words that stand in a match, the items matched.

    See the module for the method, the bound on what is broadcast, and the cases.
    """
    groups = item_groups(items, item_col, text_col, group_bytes)
    first, second = next(groups), next(groups, None)
    if second is None:
        phrases = Phrases(first, window)
        return search_postings(build_postings(docs, phrases), phrases, slop)
    # ids may repeat or be null; written, so that a row has one key in every search
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    postings = materialize(build_postings(rows.select(F.col("_row").alias("doc_id"), "text")))
    every = None
    for group in chain((first, second), groups):
        found = search_postings(postings, Phrases(group, window), slop)
        every = found if every is None else every.unionByName(found)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    whole = every.groupBy(F.col("doc_id").alias("_row")).agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("_row", "doc_id").join(whole, "_row").select("doc_id", "n_words", joined_spans(F.col("spans")).alias("spans"), "items")


def joined_spans(spans):
    """Sorted spans with those that touch or overlap made one."""
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def hit_words(spans):
    """Words that lie in the spans of a document."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
