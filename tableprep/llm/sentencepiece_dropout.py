"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary of a BPE model with byte fallback is read from a file whose path is a parameter. Encoding keeps an
agenda of candidate merges and takes the best, leftmost first. Each candidate is skipped for good when a hash keyed
by seed, document, place and merged piece falls below the dropout rate, so the same seed gives the same tokens on any
machine, another seed gives other ones, and all of them decode to the same text.

Pieces never reach over a blank or a character outside the vocabulary, so a text falls apart into short units whose
agendas are independent. A task runs the agendas of many units side by side in numpy, one merge of each per step;
a unit too long for that runs its own with a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
BLANK = "▁"
LONGEST_UNIT = 48
PIECE_CHARS = 1 << 18
_NONE = np.int32(2**31 - 1)
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Pairs:
    """Which two pieces merge into which: a hash table looked up for whole arrays."""

    def __init__(self, merges: dict[tuple[int, int], int]):
        self.shift = _U(64 - max(10, (8 * len(merges)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE, np.int32)
        for (left, right), merged in merges.items():
            at = int(self._slot(np.array([left << 32 | right]))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = left << 32 | right, merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class PieceModel:
    """A BPE vocabulary with byte fallback: `encode` and `decode` for lists of texts."""

    def __init__(self, model_path: str = DEFAULT_MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        ordinary = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in ordinary}
        ids = {name: i for i, name in names.items()}
        if any(BLANK in name.lstrip(BLANK) for name in names.values()):
            raise ValueError("pieces of this model reach over blanks")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(model.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.char_ids = np.full(0x110000, -1, np.int32)
        for i, name in names.items():
            if len(name) == 1:
                self.char_ids[ord(name)] = i
        self.blank = int(self.char_ids[ord(BLANK)])
        # A blank becomes the blank mark; a mark that stands in a text itself goes by bytes, so both come back.
        self.char_ids[ord(" ")], self.char_ids[ord(BLANK)] = self.blank, -1
        merges = {
            (ids[name[:k]], ids[name[k:]]): i
            for i, name in names.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids
        }
        self.pairs = _Pairs(merges)
        scores = np.array([model.get_score(i) for i in range(n)])
        # Equal scores share a rank, so that the leftmost goes first among them. The last entry stands for no piece.
        self.rank = np.full(n + 1, _NONE, np.int32)
        kinds, self.rank[ordinary], shared = np.unique(-scores[ordinary], return_inverse=True, return_counts=True)
        self.piece_at = np.full(len(kinds), -1, np.int32)
        alone = [i for i in ordinary if shared[self.rank[i]] == 1]
        self.piece_at[self.rank[alone]] = alone
        self.bytes_of = [b""] * n
        for i, name in names.items():
            self.bytes_of[i] = name.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])

    def rank_of(self, pieces: np.ndarray) -> np.ndarray:
        return self.rank[np.minimum(pieces, len(self.rank) - 1)]

    def _dropped(self, keys: np.ndarray, starts: np.ndarray, merged: np.ndarray, rate: float) -> np.ndarray:
        place = starts.astype(_U) * _U(0x9E3779B97F4A7C15) + merged.astype(_U) * _U(0xD1B54A32D192ED03)
        return (_mixed(keys + place) >> _U(11)) < _U(int(rate * (1 << 53)))

    def _candidates(self, keys, left, right, starts, rate) -> np.ndarray:
        """The piece that each pair merges into, or _NONE where there is none or it is dropped."""
        merged = self.pairs.of(left, right)
        real = np.flatnonzero(merged != _NONE)
        if rate > 0 and len(real):
            gone = self._dropped(keys[real], starts[real], merged[real], rate)
            merged[real[gone]] = _NONE
        return merged

    def _side_by_side(self, symbols: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of units of like length, one merge of each per step. Rows are padded with -1."""
        n, width = symbols.shape
        final, sizes = symbols.copy(), (symbols >= 0).sum(axis=1)
        rows, size, current = np.arange(n), sizes.copy(), symbols
        starts = np.tile(np.arange(width, dtype=np.int8), (n, 1))
        ranks = np.full((n, width), _NONE, np.int32)
        r, c = np.nonzero(symbols[:, 1:] >= 0)
        ranks[r, c] = self.rank_of(self._candidates(keys[r], symbols[r, c], symbols[r, c + 1], c, rate))
        span = np.arange(width)
        while True:
            best = ranks.argmin(axis=1)
            rank = ranks.ravel()[np.arange(len(rows)) * width + best]
            live = rank != _NONE
            if not live.all():
                done = ~live
                final[rows[done]], sizes[rows[done]] = current[done], size[done]
                rows, current, size, starts, ranks, best, rank = (x[live] for x in (rows, current, size, starts, ranks, best, rank))
                if not len(rows):
                    return final, sizes
            base = np.arange(len(rows)) * width
            merged = self.piece_at[rank]
            shared = np.flatnonzero(merged < 0)
            if len(shared):
                merged[shared] = self.pairs.of(current.ravel()[base[shared] + best[shared]], current.ravel()[base[shared] + best[shared] + 1])
            current.ravel()[base + best] = merged
            take = np.minimum(span + (span > best[:, None]), width - 1) + base[:, None]
            current, starts, ranks = current.ravel()[take], starts.ravel()[take], ranks.ravel()[take]
            size -= 1
            current.ravel()[base + size], ranks.ravel()[base + size], ranks.ravel()[base + size - 1] = -1, _NONE, _NONE
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best + 1 < size)
            own = np.concatenate([left, right])
            at = np.concatenate([best[left] - 1, best[right]])
            flat = base[own] + at
            symbols_flat = current.ravel()
            new = self._candidates(keys[rows[own]], symbols_flat[flat], symbols_flat[flat + 1], starts.ravel()[flat], rate)
            ranks.ravel()[flat] = self.rank_of(new)

    def _by_heap(self, symbols: np.ndarray, key: np.uint64, rate: float) -> list[int]:
        """The agenda of one unit of any length: a heap of candidates over a linked list of symbols."""
        n = len(symbols)
        ids, after, before = [int(s) for s in symbols], list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        keys = np.array([key])

        def offer(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            merged = self._candidates(np.broadcast_to(keys, at.shape), left, right, at, rate)
            for a, m, x, y in zip(at.tolist(), merged.tolist(), left.tolist(), right.tolist()):
                if m != _NONE:
                    heapq.heappush(agenda, (int(self.rank[m]), a, m, x, y))

        offer(np.arange(n - 1), np.asarray(symbols[:-1]), np.asarray(symbols[1:]))
        while agenda:
            _, at, merged, left, right = heapq.heappop(agenda)
            following = after[at]
            if ids[at] != left or following >= n or ids[following] != right:
                continue
            ids[at], ids[following] = merged, -1
            after[at] = after[following]
            if after[at] < n:
                before[after[at]] = at
                offer(np.array([at]), np.array([merged]), np.array([ids[after[at]]]))
            if before[at] >= 0:
                offer(np.array([before[at]]), np.array([ids[before[at]]]), np.array([merged]))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str], text_keys: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts end to end, and where each text's begin. Empty texts have none."""
        joined = "".join(" " + t if t else "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        symbols = self.char_ids[points]
        if not len(symbols):
            return np.zeros(0, np.int32), bounds
        other, blank = symbols < 0, symbols == self.blank
        begins = np.ones(len(symbols), bool)
        begins[1:] = (blank[1:] & ~blank[:-1]) | other[1:] | other[:-1]
        begins[bounds[:-1][lengths > 0]] = True
        firsts = np.flatnonzero(begins)
        sizes = np.diff(np.append(firsts, len(symbols)))
        owner = np.searchsorted(bounds, firsts, side="right") - 1
        keys = _mixed(_mixed(text_keys[owner] + _mixed(np.array([seed], np.int64).view(_U))) + (firsts - bounds[owner]).astype(_U))
        counts = np.ones(len(firsts), np.int64)
        placed: list[tuple[np.ndarray, np.ndarray]] = []  # (units, tokens of each unit padded with -1)
        unknown = np.flatnonzero(other[firsts])
        raw = [chr(p).encode() for p in points[firsts[unknown]]]
        if raw:
            counts[unknown] = [len(x) for x in raw]
            padded = np.full((len(raw), 4), -1, np.int32)
            for i, x in enumerate(raw):
                padded[i, : len(x)] = self.byte_ids[list(x)]
            placed.append((unknown, padded))
        single = np.flatnonzero((sizes == 1) & ~other[firsts])
        placed.append((single, symbols[firsts[single]][:, None]))
        low = 1
        for high in (4, 6, 8, 11, 16, 24, LONGEST_UNIT):
            units = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(units):
                at = firsts[units][:, None] + np.arange(high)
                inside = np.arange(high) < sizes[units][:, None]
                rows = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
                tokens, counts[units] = self._side_by_side(rows, keys[units], rate)
                placed.append((units, tokens))
        longer: list[tuple[int, list[int]]] = []
        for unit in np.flatnonzero(sizes > LONGEST_UNIT):
            longer.append((unit, self._by_heap(symbols[firsts[unit] : firsts[unit] + sizes[unit]], keys[unit], rate)))
            counts[unit] = len(longer[-1][1])
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], np.int32)
        for units, tokens in placed:
            real = tokens >= 0
            out[(ends[units][:, None] + np.arange(tokens.shape[1]))[real]] = tokens[real]
        for unit, tokens in longer:
            out[ends[unit] : ends[unit + 1]] = tokens
        return out, ends[np.searchsorted(firsts, bounds)]

    def decode(self, tokens) -> str:
        """The text of a list of tokens. Control pieces stand for nothing; broken byte sequences become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[t] for t in tokens])[1:].decode("utf-8", "replace")


_loaded: dict[str, PieceModel] = {}


def load(model_path: str) -> PieceModel:
    """One model per worker and path."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceModel(model_path)
    return _loaded[model_path]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL,
    dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """Id, tokens, n_tokens and round_trip (whether the tokens decode to the text) for every row.

    Null texts have null tokens, no count and no verdict; empty ones an empty list. Rows with the same id and text
    get the same tokens; a null id draws like an empty one. Every executor must find the model at `model_path`.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = batch.column(1).to_numpy().view(np.uint64)
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < PIECE_CHARS):
                    size += len(texts[b] or "")
                    b += 1
                part = [t or "" for t in texts[a:b]]
                tokens, starts = model.encode(part, keys[a:b], dropout, seed)
                flat = tokens.tolist()
                same = [model.decode(flat[starts[i] : starts[i + 1]]) == part[i] for i in range(b - a)]
                missing = np.array([t is None for t in texts[a:b]])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tokens), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b], lists, pa.array(np.diff(starts), pa.int64(), mask=missing),
                        pa.array(same, pa.bool_(), mask=missing),
                    ],
                    [id_col, "tokens", "n_tokens", "round_trip"],
                )
                a = b

    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias(id_col), F.xxhash64(number).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoded, f"`{id_col}` long, tokens array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Id and text of every row of tokens; null tokens give a null text, an empty list an empty one."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [None if t is None else model.decode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias(id_col), tokens_col)
    return rows.mapInArrow(decoded, f"`{id_col}` long, text string")
