"""Substring dedup, decontamination, near dedup: against brute force, and the awkward cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from solidframe.llm.components import connected_components
from solidframe.llm.decontamination import Phrases, build_postings, decontaminate, hit_words, joined_spans, search_postings
from solidframe.llm.near_dedup import _each_set, near_duplicates
from solidframe.llm.shared import ALNUM, FOLDED, PLAIN, column_bytes, window_hash
from solidframe.llm.substring_dedup import COVERS, period_for, substring_dedup


def words_of(text):
    return (text or "").encode().split()


def removed(rows, size):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("size", [1, 5, 20, 50])
def test_substring_dedup(docs_of, texts, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs_of(texts), size).collect()}
    assert got == removed(texts, size)


def test_substring_dedup_cases(docs_of):
    text = " ".join(map(str, range(30)))
    assert substring_dedup(docs_of([]).filter("false")).count() == 0
    rows = substring_dedup(docs_of([(1, text), (1, text), (None, text), (2, text + " end")]), 20).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed, r.kept_text) for r in rows) == [(-1, 0, text), (1, 30, ""), (1, 30, ""), (2, 30, "end")]
    spans = substring_dedup(docs_of([(1, text), (2, "a  b\n" + text + "\nc  d")]), 20, layout="lines").filter("doc_id = 2").first()
    assert spans.kept_text == "a  b\nc  d" and [(s.start, s.end) for s in spans.removed] == [(2, 32)]


@pytest.mark.parametrize("period", COVERS)
def test_difference_covers(period):
    cover = COVERS[period]
    assert all(any((i + k) % period in cover and (j + k) % period in cover for k in range(period)) for i in range(period) for j in range(period))
    assert period_for(20) == 13 and period_for(50) == 31 and period_for(1) == 1


def test_word_cutting(texts):
    import pyarrow as pa

    column = pa.array([t for _, t in texts])
    for how, pattern, lower in ((PLAIN, r"[^\x20\x09-\x0D]+", False), (FOLDED, r"[^\x20\x09-\x0D]+", True), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        data, offsets = column_bytes(column)
        hashes, starts, ends, firsts = how.cut(data, offsets)
        ids = {}
        for k, (_, t) in enumerate(texts):
            t = "".join(c.lower() if lower and "A" <= c <= "Z" else c for c in t or "")
            want = re.findall(pattern, t)
            own = slice(firsts[k], firsts[k + 1])
            assert firsts[k + 1] - firsts[k] == len(want)
            for w, h, a, b in zip(want, hashes[own], starts[own], ends[own], strict=True):
                assert ids.setdefault(w, h) == h and len(w.encode()) == b - a
        assert len(set(ids.values())) == len(ids)
    assert len(set(window_hash(np.arange(50, dtype=np.uint64), 3).tolist())) == 48


ITEMS = [(1, "w1 w2, W3! w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "one"), (3, "w7 w7"), (4, None), (5, "  ,,"), (6, "w1 w2, W3! w4 w5 w6 w7 w8 w9 w10 w11 w12"), (10, "É w3")]


def hits(rows, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    phrases = [(str(i), tuple(w[k : k + min(window, len(w))])) for i, t in items for w in [cut(t)] if w for k in range(len(w) - min(window, len(w)) + 1)]
    out = {}
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for name, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(name)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize(("window", "group"), [(10, 1 << 20), (2, 1 << 20), (2, 40)])
def test_decontamination(spark, docs_of, texts, window, group):
    rows = [*texts, (70, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 y"), (71, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (72, "w11 w12")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs_of(rows), items, window, group_bytes=group).select("doc_id", "n_words", hit_words(F.col("spans")), "items").collect()
    assert {r[0]: (r[1], r[2], list(r[3])) for r in out} == hits(rows, ITEMS, window)


@pytest.mark.parametrize("case", ["contained", "late"])
def test_near_duplicates_of_crowded_documents_at_the_threshold(spark, docs_of, case):
    import pyarrow as pa

    words = [f"v{k}" for k in range(160)]
    batch = pa.record_batch([pa.array(range(160)), pa.array(words)], ["doc_id", "text"])
    words = [w for _, w in sorted((int(x[0]), w) for _, sets in _each_set([batch], 1) for x, w in zip(sets, words, strict=True))]
    if case == "contained":  # 100 of 125 words, 16 of the 32 kept
        more = set(words[1:32:2] + words[32:41])
        one, other = words[:125], [w for w in words[:125] if w not in more]
    else:  # 64 of 80 words, none of the first 8 kept ones
        one, other = words[0:16:2] + words[16:80], words[1:16:2] + words[16:80]
    out = near_duplicates(docs_of([(1, " ".join(one)), (2, " ".join(other))]), shingle=1, list_rows=1).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 1, False)]


def test_decontamination_keeps_rows_of_repeated_ids_with_many_items(spark, docs_of):
    items = spark.createDataFrame([(k, f"i{k} j{k} k{k}") for k in range(8)], "item_id long, text string")
    some = docs_of([(1, "x i1 j1 k1 y i5 j5 k5"), (1, "clean words"), (1, "clean words"), (None, "i2 j2 k2"), (None, "clean"), (None, None), (4, "i7 j7 k7")])
    rows = lambda group: sorted(str((r.doc_id, r.n_words, r.spans, r["items"])) for r in decontaminate(some, items, 3, group_bytes=group).collect())
    assert len(rows(20)) == 7 and rows(20) == rows(1 << 20)


def test_decontamination_cases(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    some = docs_of([(1, "a b x d e"), (2, "a x b c d e"), (3, "e d c b a"), (1, "a b c d e")])
    near = lambda slop: sorted((r.doc_id, len(r.spans) > 0) for r in decontaminate(some, items, 5, slop=slop).collect())
    assert near(0) == [(1, False), (1, True), (2, False), (3, False)] and (2, True) in near(1) and (3, False) in near(1)
    assert decontaminate(docs_of([]).filter("false"), items).count() == 0
    none = decontaminate(some, items.filter("false")).collect()
    assert len(none) == 4 and not any(r.spans or r["items"] for r in none)
    whole = build_postings(some.select("doc_id", "text")).collect()
    assert sum(len(r.positions) // 4 for r in whole) == 21
    joined = spark.sql("SELECT array(struct(0L as start, 3L as end), struct(3L as start, 5L as end), struct(7L as start, 9L as end)) AS s").select(joined_spans(F.col("s")).alias("s")).first().s
    assert [(x.start, x.end) for x in joined] == [(0, 5), (7, 9)]


def test_stored_postings_are_searched_again(spark, docs_of, texts, tmp_path):
    rows = [*texts, (70, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 y")]
    build_postings(docs_of(rows)).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for items in (ITEMS, [(20, "w3 w1"), (21, "a"), (22, "none here")]):
        out = search_postings(index, Phrases([(str(i), t) for i, t in items], 2)).select("doc_id", "n_words", hit_words(F.col("spans")), "items").collect()
        assert {r[0]: (r[1], r[2], list(r[3])) for r in out} == hits(rows, items, 2)


def components(rows, shingle, percent=80):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize(("shingle", "limits"), [(2, {}), (5, {}), (2, {"list_rows": 2, "list_part": 7, "cluster_part": 5, "broadcast_rows": 3}), (5, {"list_rows": 1, "list_part": 2, "cluster_part": 2}), (2, {"exact": True})])
def test_near_duplicates(docs_of, texts, shingle, limits):
    import random

    rng = random.Random(shingle)
    rows, base = list(texts), " ".join(f"b{rng.randrange(90)}" for _ in range(150))
    rows += [(100 + k, edited(rng, base, rng.randrange(0, 9))) for k in range(40)]  # around the threshold, of each other
    rows += [(200 + k, edited(rng, rows[10 + k][1], 1)) for k in range(20)]
    rows += [(300, "a b"), (301, "A  B"), (302, "a b c d e f"), (303, "a b c d e f g"), (304, base), (305, base)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(rows), shingle, **limits).collect()}
    assert got == components(rows, shingle)


def test_near_duplicates_cases(docs_of):
    assert near_duplicates(docs_of([]).filter("false")).count() == 0
    rows = near_duplicates(docs_of([(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, None), (7, None)]), 2).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in rows) == [(-1, 5, False), (5, 5, True), (5, 5, True), (6, 6, True), (7, 7, True)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 50), (52, 52), (None, 3)], [(k, (k * 7) % 41) for k in range(41)]])
def test_components(spark, edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in up} and len(got) == len(up)


def test_query_one_against_hashes(spark, sf_dir):
    from solidframe.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in removed(rows, 20).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
    assert got == want
