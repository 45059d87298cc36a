"""Suffix-array dedup by hash-compared suffix sort.

Every byte covered by a string of 200 bytes that also starts elsewhere is removed. A suffix array of a whole corpus
does not fit one machine, so suffixes are first dealt to where their equals are: of the 64-byte grams a window of 200
bytes begins with or holds, the one of least hash is its anchor, and equal windows have equal anchors. Neighbouring
windows with one anchor form a stretch of some 270 bytes. It is longer where the anchor recurs. A stretch that occurs twice is settled by its hash. Where
stretches differ but share an anchor, one of each kind is sorted: suffixes are merged by a mergesort that compares two
of them through prefix polynomial hashes, a binary search finding how far they agree, and neighbours in the order that
agree over 200 bytes repeat each other, which is checked on the bytes.

Stretches are settled by 128 bits of hash. Anchors that stand in many documents are found in a sample and dealt out
salted, and an anchor with too many different stretches for one task is split by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import pieces, text_buffer
from tableprep.session import materialize

MATCH = 200  # bytes
GRAM = 64  # bytes of an anchor
SPAN = MATCH - GRAM + 1  # anchors a match can start with
HOT_SAMPLE = 4096  # documents looked at to find anchors that need salting
HOT_SHARE = 0.01
SALTS = 32
LARGEST_CLASS = 4096  # different stretches of one anchor that are sorted together
WINDOWS_SORTED = 1 << 19  # windows sorted at a time
_U = np.uint64
_RNG = np.random.default_rng(6_180_339)
_BYTES = _RNG.integers(1, 2**64, 256, _U) | _U(1)
_TURN, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 21)
            up, down = np.full(size, _TURN, _U), np.full(size, _BACK, _U)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * _Powers.of(len(data))[0], out=out[1:])
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, _U)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def stretches(data: np.ndarray, starts: np.ndarray):
    """first, last, anchor hash, slice hash, self-repeat flag of every stretch of windows that share their least gram."""
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none, none, none.astype(_U), none.astype(_U), none.astype(bool)
    prefix = prefix_hashes(data)
    down = _Powers.of(len(data))[1]
    n = len(data) - GRAM + 1
    gram = _mixed((prefix[GRAM:] - prefix[:n]) * down[:n])
    least = _sliding_min(gram, SPAN)
    inside = np.zeros(len(data) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(starts) >= MATCH)
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, starts[long_ + 1] - MATCH + 1, -1)
    valid = np.cumsum(inside[: len(least)]) > 0
    places = np.flatnonzero(valid)
    if not len(places):
        return none, none, none.astype(_U), none.astype(_U), none.astype(bool)
    value = least[places]
    new = np.ones(len(places), bool)
    new[1:] = (value[1:] != value[:-1]) | (places[1:] != places[:-1] + 1)
    docs_begin = np.zeros(len(data) + 1, bool)
    docs_begin[starts[:-1]] = True
    new |= docs_begin[places]
    at = np.flatnonzero(new)
    first = places[at]
    last = places[np.append(at[1:], len(places)) - 1]
    run = np.cumsum(new) - 1
    again = (gram[places] == value) & ~np.append(new[1:], True)
    itself = np.zeros(len(first), bool)
    itself[run[again]] = True
    view = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_64_intdigest
    slices = np.fromiter((digest(view[a : b]) for a, b in zip(first.tolist(), (last + MATCH).tolist())), _U, len(first))
    return first, last, value[at], slices, itself


class SuffixSort:
    """Sorts windows of a text by their first 200 bytes, each within its class."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = prefix_hashes(data)
        self.up = _Powers.of(len(data) + 1)[0]
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
        self.head = np.zeros(len(data), _U)
        for k in range(8):
            self.head |= padded[k : k + len(data)] << _U(56 - 8 * k)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, up to 200, the suffixes agree in: binary search over hashes of their beginnings."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        shift, at_a, at_b = self.up[b - a], self.prefix[a], self.prefix[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), MATCH)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            equal = (self.prefix[a + middle] - at_a) * shift == self.prefix[b + middle] - at_b
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a comes before, with or after that at b."""
        head_a, head_b = self.head[a], self.head[b]
        out = (head_a > head_b).astype(np.int8) - (head_a < head_b)
        tied = np.flatnonzero(head_a == head_b)
        if len(tied):
            x, y = a[tied], b[tied]
            n = self.common(x, y)
            off = np.flatnonzero(n < MATCH)
            byte_a, byte_b = self.data[x[off] + n[off]], self.data[y[off] + n[off]]
            out[tied[off]] = (byte_a > byte_b).astype(np.int8) - (byte_a < byte_b)
        return out

    def _rank(self, order: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, after_equal: np.ndarray) -> np.ndarray:
        """Place of order[at] in the sorted run order[low:high], behind equal ones where after_equal."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            found = self.compare(order[middle], order[at[open_]])
            less = (found < 0) | ((found == 0) & after_equal[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def sort(self, windows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Windows, given in order of class, sorted within each class.

        A stable sort puts them in order of their first eight bytes; those that tie are then merged in runs of 1, 2, 4, ...
        by comparing suffixes.
        """
        order = windows[np.lexsort((self.head[windows], classes))]
        places = np.sort(classes, kind="stable")
        new = (places[1:] != places[:-1]) | (self.head[order[1:]] != self.head[order[:-1]])
        classes = np.concatenate([[0], np.cumsum(new)]) if len(order) else places
        begin = np.searchsorted(classes, classes, side="left")
        end = np.searchsorted(classes, classes, side="right")
        here = np.arange(len(order))
        inside, longest, run = here - begin, int((end - begin).max(initial=0)), 1
        while run < longest:
            number = inside // run
            left = number % 2 == 0
            other = np.where(left, number + 1, number - 1)
            low = np.minimum(begin + other * run, end)
            high = np.minimum(low + run, end)
            rank = self._rank(order, here, low, high, ~left)
            base = np.minimum(begin + (number - number % 2) * run, end)
            placed = np.empty_like(order)
            placed[base + (inside - number * run) + (rank - low)] = order
            order, run = placed, run * 2
        return order

    def repeated(self, windows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Which windows have an equal one in their class.

        A window whose hash stands alone in its class has none. Of the others two of each hash are sorted, which near copies
        have in thousands, and the rest is compared with the first of its hash.
        """
        hashes = (self.prefix[windows + MATCH] - self.prefix[windows]) * _Powers.of(len(self.data) + 1)[1][windows]
        order = np.lexsort((hashes, classes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (classes[order[1:]] != classes[order[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        kind = np.cumsum(new) - 1
        two = order[(size[kind] > 1) & (np.arange(len(order)) - begin[kind] < 2)]
        found = self._neighbours(windows[two], classes[two])
        if found is None:
            return self._by_bytes(windows, classes)
        on = np.zeros(len(windows), bool)
        on[two] = found
        rest = np.flatnonzero((size[kind] > 1) & (np.arange(len(order)) - begin[kind] >= 2))
        first, rest = order[begin[kind[rest]]], order[rest]
        if not self._same(windows[first], windows[rest]).all():  # hashes collide
            return self._by_bytes(windows, classes)
        on[rest] = on[first]
        return on

    def _same(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        same = np.ones(len(left), bool)
        for k in range(0, MATCH, 8):
            same &= self.head[left + k] == self.head[right + k]
        return same

    def _neighbours(self, windows: np.ndarray, classes: np.ndarray) -> np.ndarray | None:
        """Which windows have an equal one beside them in the sorted order; None if hashes collide, as the order may be wrong."""
        order = self.sort(windows, classes)
        left, right = order[:-1], order[1:]
        near = np.flatnonzero((classes[1:] == classes[:-1]))
        near = near[self.head[left[near]] == self.head[right[near]]]
        near = near[self.common(left[near], right[near]) >= MATCH]
        if not self._same(left[near], right[near]).all():
            return None
        on = np.zeros(len(self.data), bool)
        on[left[near]] = True
        on[right[near]] = True
        return on[windows]

    def _by_bytes(self, windows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        raw = self.data.tobytes()
        keys = [(c, raw[w : w + MATCH]) for w, c in zip(windows.tolist(), classes.tolist())]
        seen: dict[tuple, int] = {}
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        return np.array([seen[key] > 1 for key in keys], bool)


def repeated_runs(slices: list[bytes], classes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, first and last window of every run of windows that have an equal one in the class of their slice.

    Slices come in order of class. Starts in a run lie at most MATCH apart, so it covers its bytes without gaps. A slice
    whose anchor recurs can be long and have several runs, with bytes between them that stand nowhere else.
    """
    lengths = np.fromiter(map(len, slices), np.int64, len(slices))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    counts = lengths - MATCH + 1
    data = np.frombuffer(b"".join(slices), np.uint8)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(offsets[:-1], counts) + inner
    on = SuffixSort(data).repeated(windows, np.repeat(np.asarray(classes, np.int64), counts))
    owner, inner = np.repeat(np.arange(len(slices)), counts)[on], inner[on]
    cut = (owner[1:] != owner[:-1]) | (inner[1:] - inner[:-1] > MATCH)
    new, end = np.ones(len(owner), bool), np.ones(len(owner), bool)
    new[1:], end[:-1] = cut, cut
    return owner[new], inner[new], inner[end]


def repeated_ranges(slices: list[bytes], classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each slice that has an equal one in its class, -1 where there is none."""
    owner, begin, end = repeated_runs(slices, classes)
    first, last = np.full(len(slices), np.iinfo(np.int64).max), np.full(len(slices), -1, np.int64)
    np.minimum.at(first, owner, begin)
    np.maximum.at(last, owner, end)
    return np.where(last < 0, -1, first), last


STRETCH_SCHEMA = "id long, tag int, first long, last long, anchor long, slice long, itself boolean, salt int"


def _stretch_rows(hot: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(2))
            for a, b in pieces(starts):
                inner = starts[a : b + 1] - starts[a]
                first, last, anchor, slices, itself = stretches(data[starts[a] : starts[b]], inner)
                if not len(first):
                    continue
                doc = np.searchsorted(inner, first, side="right") - 1
                at = pa.array(doc + a)
                ids = batch.column(0).take(at)
                salt = 1 + (_mixed(ids.to_numpy().view(_U)) % _U(SALTS)).astype(np.int32)
                salt = np.where(np.isin(anchor.view(np.int64), hot), salt, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, batch.column(1).take(at), pa.array(first - inner[doc]), pa.array(last - inner[doc]),
                        pa.array(anchor.view(np.int64)), pa.array(slices.view(np.int64)), pa.array(itself), pa.array(salt),
                    ],
                    ["id", "tag", "first", "last", "anchor", "slice", "itself", "salt"],
                )

    return rows


def _hot_anchors(docs: DataFrame, total: int) -> np.ndarray:
    """Anchors that stand in at least a hundredth of a sample of documents; there can be a few thousand at most."""
    share = min(1.0, HOT_SAMPLE / max(1, total))
    picked = docs.where(F.pmod(F.xxhash64(F.lit("anchors"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = picked.mapInArrow(_stretch_rows(np.zeros(0, np.int64)), STRETCH_SCHEMA).groupBy("anchor").agg(F.count_distinct("id").alias("n"))
    least = max(8.0, HOT_SHARE * min(total, HOT_SAMPLE))
    return np.sort(np.array([r["anchor"] for r in found.where(F.col("n") >= least).select("anchor").collect()], np.int64))


FLAGGED_SCHEMA = "id long, tag int, first long, last long, anchor long, slice long, salt int, settled boolean, sample boolean"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps stretches that occur twice (settled) and one of each kind that may hold repeats (sample).

    Rows come sorted by anchor, salt and slice, so one row and the first slice of its anchor is all that is remembered.
    """
    held, before, opening = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if table.num_rows > 1:
            out, before, opening = _judge_sorted(table, before, opening, False)
            yield out
        held = table.slice(table.num_rows - 1)
    if held is not None:
        yield _judge_sorted(held, before, opening, True)[0]


def _judge_sorted(table: pa.RecordBatch, before, opening, ends: bool):
    """Judges all rows but the last, which waits for its successor, or all if the stream ends."""
    anchor, kind, salt = (table.column(k).to_numpy() for k in (4, 5, 7))
    n = table.num_rows if ends else table.num_rows - 1
    same_anchor = np.zeros(table.num_rows + 1, bool)  # of a row and the one before it
    same_anchor[1:-1] = (anchor[1:] == anchor[:-1]) & (salt[1:] == salt[:-1])
    same = same_anchor.copy()
    same[1:-1] &= kind[1:] == kind[:-1]
    if before is not None:
        same_anchor[0] = before[0] == anchor[0] and before[1] == salt[0]
        same[0] = same_anchor[0] and before[2] == kind[0]
    row = np.arange(table.num_rows)
    began = np.maximum.accumulate(np.where(same_anchor[:-1], -1, row))
    first_kind = np.where(began >= 0, kind[np.maximum(began, 0)], opening if opening is not None else 0)
    settled = same[:-1] | same[1:]
    several = (kind != first_kind) | (same_anchor[1:] & ~same[1:])
    sample = ~same[1:] & (several | table.column(6).to_numpy(zero_copy_only=False) | (salt > 0))
    keep = np.flatnonzero((settled | sample)[:n])
    rows = table.take(pa.array(keep))
    out = pa.RecordBatch.from_arrays(
        [*(rows.column(k) for k in (0, 1, 2, 3, 4, 5, 7)), pa.array(settled[keep]), pa.array(sample[keep])],
        ["id", "tag", "first", "last", "anchor", "slice", "salt", "settled", "sample"],
    )
    return out, (anchor[n - 1], salt[n - 1], kind[n - 1]), first_kind[n - 1]


SLICE_SCHEMA = "id long, tag int, first long, anchor long, open boolean, bytes binary"


def _cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_buffer(batch.column(2))
        view = memoryview(np.ascontiguousarray(data))
        cut = {k: [] for k in ("id", "tag", "first", "anchor", "open", "bytes")}
        for i, (number, tag, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
            for s in wanted or ():
                at = int(starts[i]) + s["first"]
                cut["id"].append(number)
                cut["tag"].append(tag)
                cut["first"].append(s["first"])
                cut["anchor"].append(s["anchor"])
                cut["open"].append(s["open"])
                cut["bytes"].append(bytes(view[at : int(starts[i]) + s["last"] + MATCH]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cut.values(), types)], list(cut))


RANGE_SCHEMA = "id long, tag int, begin long, end long"


def _sorted_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of whole classes, many small ones at a time. Rows come sorted by anchor."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        runs = zip(*(x.tolist() for x in repeated_runs([r[5] for r in rows], [r[6] for r in rows])))
        hit = [(rows[k][0], rows[k][1], rows[k][2] + a, rows[k][2] + b + MATCH) for k, a, b in runs if rows[k][4]]
        columns = list(zip(*hit)) if hit else [(), (), (), ()]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "tag", "begin", "end"])

    held, windows, number, anchor = [], 0, -1, None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if row[3] != anchor:
                if windows >= WINDOWS_SORTED:
                    yield judged(held)
                    held, windows = [], 0
                anchor, number = row[3], number + 1
            held.append((*row, number))
            windows += len(row[5]) - MATCH + 1
    if held:
        yield judged(held)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the slices of a large class by its hash."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            view = memoryview(row[5])
            n = len(view) - MATCH + 1
            hashes = np.fromiter((digest(view[i : i + MATCH]) for i in range(n)), _U, n).view(np.int64)
            fixed = [pa.array([x] * n, t) for x, t in zip(row[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(hashes), pa.array(np.arange(n))], ["id", "tag", "first", "anchor", "open", "window", "at"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_buffer(batch.column(2))
        numbers, runs, digests, spans = [], [], [], []
        for i, found in enumerate(batch.column(3).to_pylist()):
            text = data[starts[i] : starts[i + 1]]
            merged: list[list[int]] = []
            for s in sorted((s["begin"], s["end"]) for s in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for begin, end in merged:
                digest.update(text[at:begin])
                at = end
            digest.update(text[at:])
            numbers.append(sum(e - b for b, e in merged))
            runs.append(len(merged))
            digests.append(digest.hexdigest())
            spans.append([{"begin": b, "end": e} for b, e in merged])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)],
            ["id", "tag", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


REMOVED_SCHEMA = "id long, tag int, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"
NO_ID = -(1 << 63)


def _settle_salted(flagged: DataFrame) -> DataFrame:
    """Brings the salted rows of an anchor together: kinds found under two salts are settled, one of each is a sample."""
    salted, rest = flagged.where("salt > 0"), flagged.where("salt = 0")
    kinds = salted.where("sample").groupBy("anchor", "slice").agg(
        (F.max("settled") | (F.count("*") > 1)).alias("twice"), F.min(F.struct("id", "tag", "first", "last")).alias("one")
    )
    kinds = materialize(kinds, "suffix-kinds")
    single = salted.where("NOT settled").join(kinds.where("twice").select("anchor", "slice").hint("merge"), ["anchor", "slice"], "left_semi")
    settled = salted.where("settled").unionByName(single).select("id", "tag", "first", "last", "anchor", F.lit(True).alias("settled"), F.lit(False).alias("sample"))
    samples = kinds.select("one.*", "anchor", F.col("twice").alias("settled"), F.lit(True).alias("sample"))
    return rest.select(settled.columns).unionByName(settled).unionByName(samples)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest_class: int = LARGEST_CLASS
) -> DataFrame:
    """What to remove from every row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges, null if none).

    Texts count as UTF-8 bytes, null as empty; texts under 200 bytes lose nothing. Rows that repeat a text lose all of
    it, whichever their ids. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("tag")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tag, text.alias("text"))
    hot = _hot_anchors(rows, docs.count())
    found = rows.mapInArrow(_stretch_rows(hot), STRETCH_SCHEMA).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "slice")
    flagged = materialize(found.mapInArrow(_classes, FLAGGED_SCHEMA), "suffix-flagged")
    flagged = materialize(_settle_salted(flagged), "suffix-settled") if len(hot) else flagged
    # Of an anchor only settled samples need no sorting: nothing in it is open.
    wanted = F.collect_list(F.when(F.col("sample"), F.struct("first", "last", "anchor", (~F.col("settled")).alias("open"))))
    spans = F.collect_list(F.when(F.col("settled"), F.struct(F.col("first").alias("begin"), (F.col("last") + MATCH).alias("end"))))
    per_doc = materialize(flagged.groupBy("id", "tag").agg(wanted.alias("wanted"), spans.alias("spans")), "suffix-documents")
    # Flagged documents have no bound: they meet their texts by a shuffle at every size.
    touched = materialize(rows.join(per_doc.hint("merge"), ["id", "tag"]).select("id", "tag", "text", "wanted", "spans"), "suffix-texts")
    slices = materialize(touched.select("id", "tag", "text", "wanted").mapInArrow(_cut_slices, SLICE_SCHEMA), "suffix-slices")
    sizes = materialize(slices.groupBy("anchor").count().where(F.col("count") > largest_class).select("anchor"), "suffix-large")
    by_sort = slices.join(sizes.hint("merge"), "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    ranges = by_sort.select("id", "tag", "first", "anchor", "open", "bytes").mapInArrow(_sorted_ranges, RANGE_SCHEMA)
    if not sizes.isEmpty():
        large = slices.join(sizes, "anchor", "left_semi").select("id", "tag", "first", "anchor", "open", "bytes")
        windows = large.mapInArrow(_window_hashes, "id long, tag int, first long, anchor long, open boolean, window long, at long")
        twice = windows.groupBy("anchor", "window").count().where(F.col("count") > 1).drop("count")
        hit = windows.where("open").join(materialize(twice, "suffix-windows").hint("merge"), ["anchor", "window"], "left_semi")
        # Starts of one bucket lie less than MATCH apart, so what they cover has no gaps.
        bucket = F.floor(F.col("at") / MATCH).alias("bucket")
        split = hit.groupBy("id", "tag", "first", bucket).agg((F.col("first") + F.min("at")).alias("begin"), (F.col("first") + F.max("at") + MATCH).alias("end"))
        ranges = ranges.unionByName(split.select("id", "tag", "begin", "end"))
    ranges = materialize(ranges, "suffix-ranges").groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("more"))
    removed = touched.select("id", "tag", "text", "spans").join(materialize(ranges, "suffix-more").hint("merge"), ["id", "tag"], "left")
    removed = removed.select("id", "tag", "text", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<begin:bigint,end:bigint>>"))).alias("all"))
    removed = removed.mapInArrow(_removed, REMOVED_SCHEMA)
    removed = materialize(removed.where("n_removed > 0").dropDuplicates(["id", "tag"]), "suffix-removed").hint("merge")
    every = rows.select("id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    none = F.lit(0).cast("long")
    return every.join(removed, ["id", "tag"], "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "spans",
    )
