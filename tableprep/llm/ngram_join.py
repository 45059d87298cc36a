"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words; equal sets are folded into one class first. MinHash bands propose which
classes could be alike, and connected classes are brought together, large components in pairs of blocks. There the
MinHash values of all pairs are compared a few at a time; a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold falls below a tolerance, and the rest is verified on the shingle sets. A task
returns what its pairs add up to for each class, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import pieces, sums_between, text_buffer
from tableprep.llm.components import components
from tableprep.session import materialize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5  # two sets of similarity 0.8 share no band once in 300,000 times
HASHES = BANDS * ROWS
STEP = 32  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 512
NO_ID = -(1 << 63)
_U = np.uint64
_RNG = np.random.default_rng(20_240_229)
_BYTES = _RNG.integers(1, 2**64, 256, _U) | _U(1)
_TURN = _U(0x9E3779B97F4A7C15)
_PLACES = _RNG.integers(1, 2**64, SHINGLE_WORDS, _U) | _U(1)
_A = _RNG.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _TURN, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and the places where each text's begin."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cut = starts[:-1][starts[:-1] < starts[1:]]
    fresh[cut] |= inside[cut]
    begins = np.flatnonzero(fresh)
    if not len(begins):
        return np.zeros(0, _U), np.zeros(len(starts), np.int64)
    bounds = np.concatenate([[0], begins, [len(data)]])
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    table = _powers(int(place.max()) + 1)
    terms = np.where(inside, _BYTES[data] * table[place], _U(0))
    hashes = _mixed(np.add.reduceat(terms, begins))
    return hashes, np.searchsorted(begins, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Texts of one to four words are one shingle; none without words."""
    words, first = word_hashes(data, starts)
    if len(words) >= SHINGLE_WORDS:
        n = len(words) - SHINGLE_WORDS + 1
        rolled = np.zeros(n, _U)
        for k in range(SHINGLE_WORDS):
            rolled += words[k : k + n] * _PLACES[k]
        rolled = _mixed(rolled)
    else:
        rolled = np.zeros(0, _U)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(rolled[a : b - SHINGLE_WORDS + 1]))
        elif b > a:
            out.append(_mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    low = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(low), 2048):
        best = np.minimum(best, (low[a : a + 2048, None] * _A + _B).min(axis=0))
    return best


def band_hashes(values: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=_U)
    for row in values.reshape(BANDS, ROWS).T:
        out = _mixed(out + row.astype(_U) * _TURN)
    return out.astype(np.int64)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches with which a pair goes on.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1), and the probability that it reaches
    the threshold is that of at most m successes in n + 1 trials at the threshold.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def _survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of left, rows of right) that are never dropped while their values are compared step by step."""
    matches = np.zeros(len(a), np.int16)
    for n, fewest in least.items():
        for c in range(0, len(a), 1 << 15):
            part = slice(c, c + (1 << 15))
            matches[part] += (left[a[part], n - STEP : n] == right[b[part], n - STEP : n]).sum(axis=1, dtype=np.int16)
        on = matches >= fewest
        a, b, matches = a[on], b[on], matches[on]
    return a, b


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets, by bits over the shingles that several sets hold."""
    if len(a) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.cumsum(counts > 1) - 1
    keep = (counts > 1)[column]
    row, column = np.repeat(np.arange(len(sets)), sizes)[keep], several[column[keep]]
    width = int((several[-1] + 1 + 63) // 64) or 1
    bits = np.zeros((len(sets), width), _U)
    np.bitwise_or.at(bits, (row, column >> 6), _U(1) << (column & 63).astype(_U))
    out = np.empty(len(a), np.int64)
    chunk = max(1, (1 << 20) // width)
    for c in range(0, len(a), chunk):
        out[c : c + chunk] = np.bitwise_count(bits[a[c : c + chunk]] & bits[b[c : c + chunk]]).sum(axis=1)
    return out


def linked_pairs(sets: list[np.ndarray], values: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])
    a, b = _survivors(values, values, a[near], b[near], least)
    if not len(a):
        return a, b
    both = _shared(sets, a, b)
    linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    return a[linked], b[linked]


SET_SCHEMA = "id long, row_hash long, n_shingles long, set1 long, set2 long, bands array<long>"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        data, starts = text_buffer(batch.column(2))
        for a, b in pieces(starts):
            sets = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            full = [len(s) > 0 for s in sets]
            bands = [band_hashes(signature(s)) for s in sets if len(s)]
            ends = np.concatenate([[0], np.cumsum(full)]).astype(np.int32) * BANDS
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["id", "row_hash", "n_shingles", "set1", "set2", "bands"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts turned into their shingles and MinHash values, as bytes."""
    for batch in batches:
        data, starts = text_buffer(batch.column(4))
        for a, b in pieces(starts):
            sets = shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k)[a:b] for k in range(4)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                ["component", "blocks", "node", "copies", "shingles", "signature"],
            )


def _judged(rows: list[tuple], least: dict[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (counting copies) and a common root for the nodes of one block, or of two blocks that meet.

    Rows are (node, copies, in the second block, shingles, signature).
    """
    nodes, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    second = np.array([r[2] for r in rows], bool)
    sets = [np.frombuffer(r[3], _U) for r in rows]
    values = np.stack([np.frombuffer(r[4], np.uint32) for r in rows])
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    if len(two):
        a, b = np.repeat(one, len(two)), np.tile(two, len(one))
    else:
        a, b = np.triu_indices(len(rows), 1)
    a, b = linked_pairs(sets, values, a, b, least, threshold)
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while len(a):  # the smallest root spreads over the links
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return nodes, links, nodes[root]


def _verify(threshold: float, tolerance: float):
    """Judges every group of rows with the same (component, first, second); the rows come sorted by that."""
    least = fewest_matches(threshold, tolerance)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if row[:3] != key and held:
                    yield held
                    held = []
                key = row[:3]
                held.append(row[3:])
        if held:
            yield held

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            nodes, links, root = _judged(rows, least, threshold)
            on = links > 0
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(links[on]), pa.array(root[on])], ["node", "links", "root"])

    return judged


def _proposed(sets: DataFrame) -> DataFrame:
    """(node, component, blocks): classes of texts that bands connect with another one."""
    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets.select("band", "first"), "near-buckets").hint("merge")
    edges = banded.join(buckets, "band").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = materialize(components(edges), "near-components")
    sizes = found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return materialize(found.join(sizes, "root").select("node", F.col("root").alias("component"), "blocks"), "near-proposed")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """Classes of texts connected by similarities of at least `threshold`.

    Returns one row per input row: the id column, copy_id (the largest id whose text has the same shingles), class_id
    (the largest id of its class), n_links (rows it is similar to, those with the same shingles included, itself not)
    and row_hash. Words are runs of anything but ASCII white space, compared as they are. Texts of one to four words
    are similar only if they have the same words; null texts and texts without words are classes of their own, without
    links. Null ids count as smaller than any. An empty table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, threshold, tolerance).drop("class_hash")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Groups with class_hash besides, the row_hash of the class's row of largest id; null for texts without words.

    Ids may be null or repeat, so classes go by numbers of their own, and class_id and class_hash together name one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    rows = materialize(keyed.mapInArrow(_set_rows, SET_SCHEMA), "near-sets")
    worded = rows.where("n_shingles > 0")
    key = ["set1", "set2"]
    sets = worded.groupBy(*key).agg(
        F.max("id").alias("top"), F.count("*").alias("copies"), F.max_by(F.struct("row_hash", "bands"), F.struct("id", "row_hash")).alias("of")
    )
    sets = sets.select(*key, "top", "copies", F.col("of.row_hash").alias("top_hash"), F.col("of.bands").alias("bands"))
    # Numbered as it is written: whoever reads the table sees the same numbers.
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    proposed = _proposed(sets).join(sets.select("node", "top", "copies", "top_hash"), "node")
    proposed = materialize(proposed, "near-members")
    # Neither members nor texts have a bound: they meet by a shuffle at every size.
    members = keyed.join(proposed.hint("merge"), (F.col("id") == F.col("top")) & (F.col("row_hash") == F.col("top_hash")))
    members = members.dropDuplicates(["node"]).select("component", "blocks", "node", "copies", "text")
    packed = materialize(members.mapInArrow(_packed, "component long, blocks long, node long, copies long, shingles binary, signature binary"), "near-packed")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = packed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(
        "component", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("last"), "node", "copies",
        (F.col("mine") > F.col("other")).alias("second"), "shingles", "signature",
    )
    group = ["component", "first", "last"]
    placed = placed.repartition(*group).sortWithinPartitions(*group)
    judged = materialize(placed.mapInArrow(_verify(threshold, tolerance), "node long, links long, root long"), "near-judged")
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(judged.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = materialize(classes, "near-linked")
    tops = classes.join(sets.select("node", "top", "top_hash"), "node")
    largest = tops.groupBy("root").agg(F.max(F.struct("top", "top_hash")).alias("of"))
    known = classes.join(largest, "root").join(links, "node")
    known = materialize(known.select("node", F.col("of.top").alias("class_id"), F.col("of.top_hash").alias("class_hash"), "links"), "near-known")
    named = sets.select(*key, "node", "top", "top_hash", "copies").join(known.hint("merge"), "node", "left")
    named = materialize(named, "near-named").hint("merge")
    full = worded.join(named, key).select(
        "id", "row_hash", F.col("top").alias("copy_id"), F.coalesce("class_id", "top").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class_hash", "top_hash").alias("class_hash"),
    )
    bare = rows.where("n_shingles = 0").select(
        "id", "row_hash", F.col("id").alias("copy_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("class_hash"),
    )
    named_back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return full.unionByName(bare).select(
        named_back("id").alias(id_col), named_back("copy_id").alias("copy_id"), named_back("class_id").alias("class_id"), "n_links", "row_hash", "class_hash"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the largest id, with all its columns.

    Texts without words are classes of their own and all stay. Of rows that share the largest id, that with the largest
    row_hash stays; of equal ones a single row.
    """
    found = materialize(_grouped(docs, id_col, text_col).where("class_hash IS NOT NULL"), "near-groups")
    text = F.coalesce(F.col(text_col), F.lit(""))
    stays = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("row_hash") == F.col("class_hash"))
    gone = found.groupBy(id_col, "row_hash").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    gone = materialize(gone.where("NOT stays OR n > 1").select(F.col(id_col).alias("__gone"), F.col("row_hash").alias("__hash"), "stays"), "near-gone")
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(text) == F.col("__hash"))
    left = docs.join(gone.hint("merge"), same, "left_anti")
    if gone.where("stays").isEmpty():
        return left
    once = docs.withColumn("__own", F.xxhash64(text))
    once = once.join(gone.where("stays"), F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__hash")), "left_semi")
    return left.unionByName(once.dropDuplicates([id_col, "__own"]).drop("__own"))
