"""Language ID by unigrams of pieces, marginalised over segmentations.

The pieces are the fixed vocabulary of a public tokenizer (a sentencepiece model file; nothing is trained
there). For each language the share of each piece is counted and smoothed. A word's probability in a language
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. The language with the largest posterior (equal priors) is predicted, its posterior is the score.

The counts come from a bounded sample: at most ``max_docs`` labelled documents of each language, those with
the smallest hash of their id. Words are counted by Spark; what reaches the driver is one number for each
language and piece, bounded by the vocabulary. Scoring is a scan without a shuffle over whole texts; each
distinct word of a few MB of text is summed once, all such words together. The model (a number for each piece
and language) reaches the tasks as a broadcast variable, which Spark makes of functions over 1 MB.

Cases: null text and text without letters is ``und`` with score 0; so is all text if nothing was learned;
ties go to the first language in code point order; characters that no piece has cost the same in every
language; equal rows agree; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column_bytes, materialize, mix, powers, runs_of_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
PREDICTIONS = "doc_id long, lang_pred string, score double"

_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"  # how the vocabulary marks the start of a word
#: Share of an unknown character; added to each count.
FLOOR, SMOOTH = 1e-7, 0.05
#: Characters times languages that are summed together; what the sums of a step take is in proportion.
ROOM = 1 << 20
#: Ids of the sample that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ids of a language that are ranked, in samples.
SPARE = 4


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(x.isalpha() or any(map(str.isalpha, x)) for x in found) else []


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for x in words_of(text):
                counts[lang, x] = counts.get((lang, x), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


def _pieces(model: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        split = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            found = split.encode(batch.column("word").to_pylist(), out_type=str, num_threads=1) if batch.num_rows else []
            for lang, own, n in zip(batch.column("lang").to_pylist(), found, batch.column("n").to_pylist(), strict=True):
                for x in own:
                    counts[lang, x] = counts.get((lang, x), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "piece", "n"])

    return pieces


class Unigrams:
    """Piece shares of each language, and the forward sums of words."""

    def __init__(self, langs: list[str], pieces: list[str], shares: np.ndarray):
        self.langs = langs
        self.longest = max(map(len, pieces), default=1)
        hashes = self._hashes("".join(pieces))(*self._spans([len(p) for p in pieces])) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.shares = hashes[order], np.vstack([shares[order], np.full((1, shares.shape[1]), FLOOR)])
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _spans(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(lengths)
        return ends - lengths, ends

    @staticmethod
    def _hashes(text: str):
        """Hashes of substrings of the text, by their starts and ends."""
        codes = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 41)
        power, back = powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1], dtype=np.uint64)])

        def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64), 42)

        return of

    def _number(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        out = np.full(len(hashes), -1)
        at = np.flatnonzero(self.slots[hashes >> np.uint64(44)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        real = self.hashes[near] == hashes[at]
        out[at[real]] = near[real]
        return out

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations of each word, for each language: all words one character on at a time."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(-lengths, kind="stable")
        out = np.empty((len(words), len(self.langs)))
        a = 0
        while a < len(order):  # words of like length together, so that the sums take bounded room
            b = a + max(1, int(ROOM // (lengths[order[a]] * max(1, len(self.langs)))))
            out[order[a:b]] = self._forward([_START + words[k] for k in order[a:b]], lengths[order[a:b]])
            a = b
        return out

    def _forward(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        starts, _ = self._spans(lengths)
        hashes = self._hashes("".join(words))
        keep = self.longest + 1
        sums = np.zeros((keep, len(words), len(self.langs)))  # of the last ends, one after the other around
        sums[0] = 1.0
        scale, out = np.zeros(len(words)), np.zeros((len(words), len(self.langs)))
        for end in range(1, int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -end, "right"))  # words that are so long
            total = sums[end % keep]
            total[:n] = 0.0
            for length in range(1, min(end, self.longest) + 1):
                number = self._number(hashes(starts[:n] + end - length, starts[:n] + end))
                at = np.flatnonzero(number >= 0) if length > 1 else np.arange(n)  # -1: the floor, of an unknown character
                total[at] += sums[(end - length) % keep][at] * self.shares[number[at]]
            top = total[:n].max(axis=1, initial=0.0)
            far = np.flatnonzero((top < 1e-100) | (top > 1e100))
            if len(far):  # long words: keep the sums in range
                sums[:, far] /= top[far][None, :, None]
                scale[far] += np.log(top[far])
            done = np.arange(int(np.searchsorted(-lengths, -end, "left")), n)
            out[done] = np.log(np.maximum(total[done], 1e-300)) + scale[done, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        number: dict[str, int] = {}
        found = [[number.setdefault(x, len(number)) for x in words_of(t)] if self.langs else [] for t in texts]
        logs = self.log_words(list(number)) if number else np.zeros((0, len(self.langs)))
        names, scores = [], []
        for own in found:
            if not own:
                names.append(UNKNOWN), scores.append(0.0)
                continue
            total = logs[own].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            names.append(self.langs[best]), scores.append(float(odds[best] / odds.sum()))
        return names, scores


def fit_unigrams(docs: DataFrame, max_docs: int = 1000, model: str = MODEL) -> Unigrams:
    """Learns from ``docs`` (doc_id, text, lang), of each non-null language at most ``max_docs`` documents."""
    import sentencepiece

    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # ids alone are ranked, and of a frequent language only those below a hash that leaves about SPARE times the sample
    sizes = materialize(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    part = (F.col("_h").cast("double") / 2.0**64) + 0.5
    known = known.join(sizes, "lang").filter(part * F.col("_n") <= SPARE * max_docs).select("doc_id", "lang", "_h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    chosen = known.withColumn("_r", place).filter(F.col("_r") <= max_docs).select("doc_id").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL").join(chosen, "doc_id", "left_semi")
    words = some.select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = words.mapInArrow(_pieces(model), "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()

    split = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [split.id_to_piece(k) for k in range(split.get_piece_size()) if not (split.is_control(k) or split.is_unknown(k) or split.is_byte(k))]
    place = {p: k for k, p in enumerate(pieces)}
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(pieces), len(langs)), SMOOTH)
    for r in rows:
        if r["piece"] in place:
            counts[place[r["piece"]], langs.index(r["lang"])] += r["n"]
    return Unigrams(langs, pieces, counts / counts.sum(axis=0) if langs else counts)


def _predict(model: Unigrams):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = column_bytes(batch.column("text"))
            for a, b in runs_of_texts(offsets, 1 << 21):
                part = batch.slice(a, b - a)
                names, scores = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify_language(docs: DataFrame, model: Unigrams) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), PREDICTIONS)
