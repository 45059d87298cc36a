"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a text is a polynomial in its bytes modulo two primes. A text is cut into chunks; all chunks of
a batch are hashed at once, and the hash of a whole text follows from those of its chunks, each shifted by the
length before it: H(ab) = H(a) + r^|a| H(b). Texts of equal fingerprint and length are then compared chunk by chunk
with the one that stays; a text that differs after all starts a group of its own, in as many rounds as it takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import pieces, sums_between, text_buffer
from tableprep.session import materialize

CHUNK = 4096  # a chunk's sum of byte * power stays below 2^53
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_298_777_689)
COMPARE_CHARS = 1 << 16
ROWS_PER_SALT = 512


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base % modulus
    return out


def combine(left: int, right: int, left_length: int, base: int, modulus: int) -> int:
    """Hash of a text from the hashes of its two halves."""
    return (left + pow(base, left_length, modulus) * right) % modulus


class Fingerprints:
    """Fingerprints of many texts at once. `moduli` is narrowed in tests to force collisions."""

    def __init__(self, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK):
        self.moduli, self.chunk = moduli, chunk
        self.powers = [_powers(b, m, chunk) for b, m in zip(BASES, moduli)]
        self.shifts = [_powers(pow(b, chunk, m), m, 64) for b, m in zip(BASES, moduli)]

    def _shifts(self, which: int, n: int) -> np.ndarray:
        if len(self.shifts[which]) < n:
            base, modulus = BASES[which], self.moduli[which]
            self.shifts[which] = _powers(pow(base, self.chunk, modulus), modulus, 2 * n)
        return self.shifts[which]

    def of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One 62-bit fingerprint per text."""
        lengths = np.diff(starts)
        chunks = -(-lengths // self.chunk)
        first = np.concatenate([[0], np.cumsum(chunks)])
        number = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
        begins = np.repeat(starts[:-1], chunks) + number * self.chunk
        sizes = np.diff(np.append(begins, starts[-1]))
        place = np.arange(len(data)) - np.repeat(begins, sizes)
        value = data.astype(np.uint64) + np.uint64(1)
        parts = []
        for which, modulus in enumerate(self.moduli):
            m = np.uint64(modulus)
            hashes = sums_between(value * self.powers[which][place], np.append(begins, starts[-1])) % m
            shifted = hashes * self._shifts(which, int(chunks.max(initial=1)))[number] % m
            parts.append(sums_between(shifted, first) % m)
        return ((parts[0] << np.uint64(31)) | parts[1]).astype(np.int64)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made lower case."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


FINGERPRINT_SCHEMA = "id long, row_hash long, fingerprint long, n_bytes long, text_sha256 string"


def fingerprints(docs: DataFrame, id_col: str, text_col: str, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per input row: id, a hash of the raw text, fingerprint, length and SHA-256 of the normalised text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprints(moduli)
        for batch in batches:
            data, starts = text_buffer(batch.column(2))
            prints, digests = [], []
            for a, b in pieces(starts):
                low = _lowered(data[starts[a] : starts[b]])
                inner = starts[a : b + 1] - starts[a]
                prints.append(maker.of(low, inner))
                view = memoryview(low)
                digests += [hashlib.sha256(view[inner[i] : inner[i + 1]]).hexdigest() for i in range(b - a)]
            prints = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints), pa.array(np.diff(starts)), pa.array(digests, pa.string())],
                ["id", "row_hash", "fingerprint", "n_bytes", "text_sha256"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    return rows.mapInArrow(hashed, FINGERPRINT_SCHEMA)


GROUP = ["fingerprint", "n_bytes", "split"]


def _unequal(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Members whose text is not that of the row that stays; both texts meet chunk by chunk.

    A group's members are spread over salts by its size, and the staying text goes to each of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.xxhash64(text).alias("text_hash"), normal.alias("text"))
    # The number of members has no bound: texts and members meet by a shuffle at every size.
    texts = texts.join(
        members.hint("merge"), F.col("text_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("row_hash"))
    ).dropDuplicates(["id", "row_hash"])
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / COMPARE_CHARS)))
    cut = texts.select("*", F.explode(cuts).alias("number"))
    cut = cut.withColumn("chunk", F.col("text").substr(F.col("number") * COMPARE_CHARS + 1, F.lit(COMPARE_CHARS))).drop("text")
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT)
    mine = cut.where(~F.col("stays")).withColumn("salt", F.pmod(F.xxhash64("id", "row_hash"), salts))
    theirs = cut.where(F.col("stays")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    theirs = theirs.select(*GROUP, "salt", "number", F.col("chunk").alias("staying"))
    met = mine.join(theirs.hint("merge"), [*GROUP, "salt", "number"], "left")
    return met.where(~F.col("chunk").eqNullSafe(F.col("staying"))).select("id", "row_hash").distinct()


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = MODULI
) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z only.

    Returns one row per input row: the id column, keep_id, group_size (rows), kept, text_sha256, row_hash. The row
    with the largest id stays; null ids come last, so a group of null ids only has a null keep_id. Null and empty
    texts form one group. Of rows that repeat both id and text, one is kept. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = fingerprints(docs, id_col, text_col, moduli).withColumn("split", F.lit(0))
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "fingerprints")
    split = 0
    while True:
        groups = rows.groupBy(*GROUP).agg(
            F.max("id").alias("keep_id"), F.count("*").alias("distinct_rows"), F.sum("copies").alias("group_size"),
            F.max_by("row_hash", F.struct("id", "row_hash")).alias("keep_hash"),
        )
        groups = materialize(groups, "print-groups").hint("merge")
        stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
        several = groups.where((F.col("distinct_rows") > 1) & (F.col("split") == split))
        members = rows.join(several, GROUP).select("id", "row_hash", *GROUP, "group_size", stays.alias("stays"))
        other = materialize(_unequal(docs, materialize(members, "equal-prints"), id_col, text_col), "unequal-texts")
        if other.isEmpty():
            break
        split += 1
        other = other.select(F.col("id").alias("other_id"), F.col("row_hash").alias("other_hash"), F.lit(split).alias("next"))
        rows = rows.join(
            other, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("row_hash") == F.col("other_hash")), "left"
        ).select(*[c for c in rows.columns if c != "split"], F.coalesce("next", "split").alias("split"))
        rows = materialize(rows, "fingerprints")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(groups, GROUP).select("*", copy.alias("copy")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept"), "text_sha256", "row_hash"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows that repeat id and text become one."""
    groups = materialize(exact_groups(docs, id_col, text_col), "exact-groups")
    gone = groups.groupBy(id_col, "row_hash").agg(F.max("kept").alias("any"), F.count("*").alias("n")).where("NOT any OR n > 1")
    gone = materialize(gone, "exact-gone").select(F.col(id_col).alias("__gone_id"), F.col("row_hash").alias("__gone_hash"), "any")
    mine = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__gone_id")) & (mine == F.col("__gone_hash"))
    left = docs.join(gone.hint("merge"), same, "left_anti")
    repeated = gone.where("any")
    if repeated.isEmpty():
        return left
    once = docs.withColumn("__hash", mine).join(repeated, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.col("__hash") == F.col("__gone_hash")), "left_semi")
    return left.unionByName(once.dropDuplicates([id_col, "__hash"]).drop("__hash"))
