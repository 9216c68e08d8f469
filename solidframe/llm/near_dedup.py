"""Near-duplicate detection by bottom-k sketches of one hash function.

A document is the set of its distinct ``shingle``-word runs, hashed to 64 bits. Documents whose sets have a
Jaccard similarity of at least ``threshold`` are linked; a component is what links reach.

1. Documents with equal sets (128-bit fingerprints) fall into one class, found by a pre-aggregated grouping,
   so exact copies cost one entry. The steps below see one representative of each class.
2. A representative keeps the k smallest hashes of its set. Inverted lists of the kept values generate
   candidates: two sets of similarity s keep no value in common with probability (1 - s)^k, 4e-23 here.
3. Lists of up to ``list_rows`` entries give overlaps (values two documents share); documents that share
   enough are estimated from the union of both sketches, and estimates far below the threshold go.
   What remains ties documents into provisional clusters.
4. Longer lists are no source of pairs. A document with a third of its values in longer lists still meets
   its partners there: it is gathered with the other such documents of a list, for its first values in longer
   lists, and their sketches are compared breadth first, so that documents already reached are not compared again.
   This ties further documents into the clusters.
5. Every cluster is searched on full sets: exact Jaccard, breadth first.
6. Links are joined into components.

A gathered list or cluster of up to ``list_part`` or ``cluster_part`` documents is one task's work; up to ``PARTS``
times that it is cut into parts, and each two parts are searched together, which makes up to ``PARTS`` rows of each
document. A larger one is first compared with one leader, part by part: what is close to the leader is tied to it, and
needs no comparison among itself. The others are then compared with all, each part of the list with each part of the
others, so the work grows with the list for lists of copies. A list with more than ``PARTS`` parts of others (documents
that share little but the value) is split before: its documents are gathered by second values in longer lists, which
makes ``GATHER`` rows of each. No partner is capped, and no task holds more than two parts.

With ``exact`` candidates come from an exact prefix filter over whole sets instead of steps 2 to 4: two linked sets
share one of their rarest values, as many as a link may miss and one more. Its lists aren't bounded, so it is for
corpora without frequent shingles, and for checking what sketches may miss.

Cases: null, empty and blank texts have empty sets and are linked with nothing; texts with fewer words than
a shingle are one shingle; a null doc_id can't be linked by others and has a null component unless its set
is shared; rows that repeat a doc_id must be equal and get equal rows; empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import FOLDED, column_bytes, materialize, mix, runs_of_texts, window_hash

SKETCH = 32
#: Values in longer lists that a document may have before it is gathered by list: with fewer, two documents
#: at the threshold share enough values of short lists but for a probability of 8e-10 (at most 4 of 22, for 0.8).
LONG_VALUES = 10
#: Values of 32 in short lists that two documents must share to be estimated.
OVERLAP = 5
#: The first values in longer lists by which a document is gathered; partners share none with probability 0.2^8.
GATHER = 8
#: Parts of a list up to which each two are searched together.
PARTS = 8


def _sets(words: np.ndarray, firsts: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    hashes = window_hash(words, shingle) >> np.uint64(1)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(hashes[a : b - shingle + 1])
        elif b > a:
            yield window_hash(words[a:b], b - a, 100 + b - a) >> np.uint64(1)
        else:
            yield hashes[:0]


def _each_set(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for a, b in runs_of_texts(offsets):
            words, _, _, firsts = FOLDED.cut(data, offsets[a : b + 1])
            yield batch.column("doc_id")[a:b], list(_sets(words, firsts, shingle))


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(own, 31).sum(dtype=np.uint64).view(np.int64)), int(mix(own, 32).sum(dtype=np.uint64).view(np.int64))


def _signatures(shingle: int, sketch: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_set(batches, shingle):
            prints = [_fingerprint(x) for x in sets]
            kept = pa.array([x[:sketch].view(np.int64) for x in sets], pa.list_(pa.int64()))
            columns = [ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()), kept]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "sketch"])

    return sign


def _full_sets(shingle: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_set(batches, shingle):
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "own"])

    return full


def _estimates(threshold: float):
    """Keeps pairs whose union sketch does not speak against a link, by five standard deviations."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("x"), batch.column("y")
            (lv, lo), (rv, ro) = ((c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)))]).astype(int)) for c in (left, right))
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                both, counts = np.unique(np.concatenate([x, y]), return_counts=True)
                # the sketch of the union: complete up to the smaller reach of two full sketches
                k = min(SKETCH, len(both))
                share = int((counts[:k] == 2).sum()) / k
                keep[i] = share >= threshold - 5 * (threshold * (1 - threshold) / k) ** 0.5
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], schema=schema)

    return estimate


def _close(percent: int):
    """Whether sketches do not speak against a link, by five standard deviations; those of whole sets tell exactly.

    Of two sets at the threshold the smaller may lie in the larger; then a share of ``percent`` of the kept
    values is expected in both (more for sets of equal size).
    """
    share = percent / 100

    def close(common: np.ndarray, one: int, other: np.ndarray) -> np.ndarray:
        least = np.minimum(one, other)
        whole = np.maximum(one, other) < SKETCH
        exact = 100 * common >= percent * (one + other - common)
        likely = common >= np.floor(share * least - 5 * (share * (1 - share) * least) ** 0.5)
        return np.where(whole, exact, likely & (100 * least >= percent * SKETCH))

    return close


def _postings(sets: list[np.ndarray], members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(sets[m]) for m in members])
    values = np.concatenate([sets[m] for m in members])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(members, lengths)[order]
    keys, first = np.unique(values, return_index=True)
    return keys, first, np.append(first[1:], len(values)), owners


def _links(data: str, enough):
    """Breadth first through a group: edges that reach all of each component of the sets that are close ``enough``,
    told from the values they share and both sizes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(table: pa.Table) -> pa.Table:
        reps, first = np.unique(table.column("rep").to_numpy(), return_index=True)
        own = table.column(data).take(first).to_pylist()
        sets = [np.frombuffer(x, np.uint64) if isinstance(x, bytes) else np.array(x, np.uint64) for x in own]
        sizes = np.array([len(x) for x in sets])
        unseen, left = np.ones(len(reps), bool), len(reps)
        known, indexed = None, 0
        out_a, out_b = [], []
        for seed in np.argsort(-sizes, kind="stable").tolist():
            if not unseen[seed]:
                continue
            unseen[seed] = False
            left -= 1
            queue = [seed]
            while queue and left:
                p = queue.pop()
                if known is None or left <= indexed // 2:  # lists of what is still unseen
                    rest = np.flatnonzero(unseen)
                    known, indexed = _postings(sets, rest), len(rest)
                keys, lo, hi, owners = known
                at = np.minimum(np.searchsorted(keys, sets[p]), len(keys) - 1)
                at = at[keys[at] == sets[p]]
                counts = hi[at] - lo[at]
                places = np.arange(counts.sum()) + np.repeat(lo[at] - np.cumsum(counts) + counts, counts)
                common = np.bincount(owners[places], minlength=len(reps))
                near = np.flatnonzero(unseen & (common > 0) & enough(common, sizes[p], sizes))
                if len(near):
                    unseen[near] = False
                    left -= len(near)
                    out_a.append(np.full(len(near), reps[p]))
                    out_b.append(reps[near])
                    queue.extend(near.tolist())
            if not left:
                break
        if not out_a:
            return schema.empty_table()
        return pa.table([np.concatenate(out_a), np.concatenate(out_b)], schema=schema)

    return link


def _star(data: str, enough):
    """Edges between the leader of a list and those of one part of it that are close ``enough``."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def star(table: pa.Table) -> pa.Table:
        key, lead = table.column("key")[0].as_py(), table.column("lead").to_numpy()
        reps = table.column("rep").to_numpy()
        sets = [np.frombuffer(x, np.uint64) if isinstance(x, bytes) else np.array(x, np.uint64) for x in table.column(data).to_pylist()]
        first = int(np.flatnonzero(lead)[0])
        common = np.array([len(np.intersect1d(sets[first], x, assume_unique=True)) for x in sets])
        sizes = np.array([len(x) for x in sets])
        near = np.flatnonzero((reps != reps[first]) & (common > 0) & enough(common, sizes[first], sizes))
        return pa.table([np.full(len(near), key), np.full(len(near), reps[first]), reps[near]], schema=schema)

    return star


def _sized(members: DataFrame) -> DataFrame:
    """``members`` (key, rep, other) with the sizes of their list: n, and o of others; lists without others or of one are left out."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("other").alias("o")).filter("n > 1 AND o > 0")
    return members.join(sizes, "key")


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """(grp, rep) for each (key, rep, other, n, o): each part of a list with each part of its ``other`` members, or where that
    makes fewer rows each two parts of the list."""
    parts = lambda n: F.when(F.col("n") > most, F.ceil(F.col(n) / most)).otherwise(1).cast("int")
    placed = members.withColumns({"p": parts("n"), "q": parts("o"), "h": F.xxhash64("rep", "key")})
    few = F.col("n") * F.col("q") + F.col("o") * F.col("p") < F.col("n") * F.col("p")
    i, j = F.pmod("h", F.col("p")).cast("int"), F.pmod("h", F.col("q")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda x, y: F.struct(x.alias("i"), y.alias("j"))
    both = F.transform(every("p"), lambda k: pair(F.least(i, k), F.greatest(i, k)))
    with_others = F.transform(every("q"), lambda k: pair(i, k))
    as_other = F.when(F.col("other"), F.transform(every("p"), lambda k: pair(k, j))).otherwise(F.slice(with_others, 1, 0))
    groups = placed.select("key", "rep", F.explode(F.when(few, F.array_union(with_others, as_other)).otherwise(both)).alias("x"))
    return groups.select(F.xxhash64("key", "x.i", "x.j").alias("grp"), "rep")


def _searched(members: DataFrame, sets: DataFrame, data: str, most: int, enough, split=None) -> DataFrame:
    """Edges (a, b) that reach all of each component of the members (key, rep) of each list that are close ``enough`` by their
    ``sets`` (rep, data). ``split`` gathers the members of a large list with many others by a second key."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("rep", "key")).alias("leader")).filter("n > 1")
    placed = materialize(members.join(sizes, "key"))
    found = _dealt(placed.filter(F.col("n") <= PARTS * most).select("key", "rep", F.lit(True).alias("other"), "n", F.col("n").alias("o")), most)
    large = placed.filter(F.col("n") > PARTS * most).withColumn("p", F.ceil(F.col("n") / most).cast("int"))
    ties = None
    if not large.isEmpty():
        part = large.select("key", "rep", F.pmod(F.xxhash64("rep", "key"), F.col("p")).cast("int").alias("i"), F.lit(False).alias("lead"))
        leaders = large.filter("rep = leader").select("key", "rep", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.lit(True).alias("lead"))
        star = part.unionByName(leaders).join(sets, "rep").groupBy("key", "i").applyInArrow(_star(data, enough), "key long, a long, b long")
        ties = materialize(star)
        near = ties.select("key", F.col("b").alias("rep"), F.lit(False).alias("other"))
        flagged = large.join(near, ["key", "rep"], "left").select("key", "rep", F.coalesce("other", F.col("rep") != F.col("leader")).alias("other"))
        sized = materialize(_sized(flagged))
        many = F.lit(False) if split is None else F.col("o") > PARTS * most
        found = found.unionByName(_dealt(sized.filter(~many), most))
        if split is not None:
            found = found.unionByName(_dealt(_sized(split(sized.filter(many))), most))
    edges = found.join(sets, "rep").groupBy("grp").applyInArrow(_links(data, enough), "a long, b long")
    return edges if ties is None else edges.unionByName(ties.select("a", "b"))


def _prefix_pairs(whole: DataFrame, percent: int) -> DataFrame:
    """(a, b) that share one of their rarest values, as many as a link of at least ``percent`` may miss and one more."""
    values = materialize(whole.select("rep", F.size("sketch").alias("m"), F.explode("sketch").alias("v")))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = values.join(counts, "v").groupBy("rep", "m").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("s"))
    first = ranked.select("rep", F.explode(F.slice("s", F.lit(1), (F.col("m") - F.ceil(F.col("m") * percent / 100) + 1).cast("int"))).alias("x")).select("rep", "x.v")
    left, right = first.select("v", F.col("rep").alias("a")), first.select("v", F.col("rep").alias("b"))
    return left.join(right, "v").filter("a < b").select("a", "b").distinct()


def _sketch_pairs(known: DataFrame, percent: int, list_rows: int, list_part: int) -> DataFrame:
    """Ties (a, b) of representatives (rep, sketch) whose sketches do not speak against a link."""
    entries = known.select("rep", F.size("sketch").alias("m"), F.posexplode("sketch").alias("rank", "v"))
    counts = entries.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(entries.join(counts, "v"))
    short, long_ = shared.filter(F.col("n") <= list_rows), shared.filter(F.col("n") > list_rows)

    left = short.select("v", F.col("rep").alias("a"), F.col("m").alias("ma"))
    right = short.select("v", F.col("rep").alias("b"), F.col("m").alias("mb"))
    overlaps = left.join(right, "v").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first(F.least("ma", "mb")).alias("m"))
    pairs = overlaps.filter(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("m") * OVERLAP / SKETCH))).select("a", "b")
    sketches = known.select("rep", "sketch")
    estimated = (
        pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
        .mapInArrow(_estimates(percent / 100), "a long, b long")
    )
    longs = long_.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("values"), F.first("m").alias("m"))
    crowded = longs.filter(F.size("values") * SKETCH > LONG_VALUES * F.col("m"))
    crowded = materialize(crowded.select("rep", F.col("values.v").alias("values")))
    gathered = crowded.select(F.explode(F.slice("values", 1, GATHER)).alias("key"), "rep")

    def split(members: DataFrame) -> DataFrame:
        others = F.slice(F.array_remove("values", F.col("key")), 1, GATHER)
        return members.join(crowded, "rep").select("key", "rep", "other", F.explode(others).alias("second")).select(F.xxhash64("key", "second").alias("key"), "rep", "other")

    return estimated.unionByName(_searched(gathered, sketches, "sketch", list_part, _close(percent), split))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, list_rows: int = 50, list_part: int = 4096, cluster_part: int = 1024, broadcast_rows: int = 1 << 20, exact: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Links join sets with 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id
    of the component, ``kept`` is true for that document. ``broadcast_rows`` bounds a broadcast of the ids
    of documents that have candidates; with more of them they are joined by a shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(texts.mapInArrow(_signatures(shingle, (1 << 31) if exact else SKETCH), "doc_id long, n long, f1 long, f2 long, sketch array<long>"))
    reps = materialize(signed.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch")))
    known = reps.filter("rep IS NOT NULL")

    pairs = _prefix_pairs(known, percent) if exact else _sketch_pairs(known, percent, list_rows, list_part)
    clusters = materialize(connected_components(pairs).select(F.xxhash64("component").alias("key"), F.col("node").alias("rep")))
    wanted = clusters.select(F.col("rep").alias("doc_id"))
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(shingle), "rep long, own binary")
    linked = lambda common, one, other: 100 * common >= percent * (one + other - common)
    found = connected_components(_searched(clusters, sets, "own", cluster_part, linked))

    classes = reps.select("f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
