"""Hash-based draws, buckets and fingerprints. All depend on values only, never on partitioning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import comparable

HEX_DIGITS = 8
HEX_SPAN = 16**HEX_DIGITS


def seeded_digest(key: Column | list[Column], seed: int) -> Column:
    """md5 text of seed and key."""
    parts = key if isinstance(key, list) else [key]
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def draw(key: Column | list[Column], seed: int) -> Column:
    """An integer in [0, 2^32) that is a fixed function of seed and key."""
    return F.conv(F.substring(seeded_digest(key, seed), 1, HEX_DIGITS), 16, 10).cast("bigint")


def unit_draw(key: Column | list[Column], seed: int) -> Column:
    """A number in [0, 1)."""
    return draw(key, seed).cast("double") / F.lit(float(HEX_SPAN))


def drawn_below(key: Column | list[Column], seed: int, share: float) -> Column:
    """Whether `unit_draw` is below a share, told from the digits of the hash."""
    bound = math.ceil(share * HEX_SPAN)
    return F.substring(seeded_digest(key, seed), 1, HEX_DIGITS) < F.lit(f"{bound:0{HEX_DIGITS}x}" if bound < HEX_SPAN else "g")


def text_bucket(column: Column, buckets: int) -> Column:
    """md5 bucket of a value's text, the same in any engine that has md5."""
    text = F.conv(F.substring(F.md5(column.cast("string")), 1, HEX_DIGITS), 16, 10)
    return text.cast("bigint") % F.lit(buckets)


def fast_bucket(column: Column, buckets: int) -> Column:
    """xxhash64 bucket: cheaper, inside code generation."""
    return F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(buckets)))


def value_fingerprint(column: Column) -> list[Column]:
    """Two independent 64-bit hashes of one value."""
    return [F.xxhash64(column), F.xxhash64(F.lit("second"), column)]


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row. Null flags are hashed too, as xxhash64 skips nulls."""
    values: list[Column] = []
    for name in df.columns:
        value = comparable(df, name)
        values += [value.isNull(), value]
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
