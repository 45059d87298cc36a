"""Looking up fitted values in one pass: broadcast behind a size check, salted by hot keys beyond it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import fresh_name, quoted
from tableprep.functions.hashing import all_of
from tableprep.session import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
NULL_SALTS = 1 << 20


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most that many rows and bytes."""
    if table.limit(rows + 1).count() > rows:
        return False
    sizes = [
        F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else
        F.lit(16) if isinstance(f.dataType, T.AtomicType) else F.coalesce(F.octet_length(F.to_json(F.struct(quoted(f.name)))), F.lit(0))
        for f in table.schema.fields
    ]
    total = sizes[0].cast("long")
    for size in sizes[1:]:
        total = total + size
    return (table.agg(F.sum(total)).first()[0] or 0) <= most_bytes


def _spread(df: DataFrame) -> Column:
    """A number that differs from row to row, from the row's own values."""
    return F.xxhash64(F.lit("spread"), *[quoted(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: list[str] | Mapping[str, Column],
    *,
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join to a table with one row per key, which adds the table's other columns.

    `on` names the keys of the table, each with the expression of the rows it must equal (by default the column of
    that name); `weight` counts the rows a key stands for. A table of checked size is broadcast. Beyond that the rows
    are shuffled once: the keys heavy enough to fill a task, at most a few per shuffle partition, are spread over
    salts, the table's rows for them repeated per salt, and rows with a null key spread at random.
    """
    on = dict(on) if isinstance(on, Mapping) else {k: quoted(k) for k in on}
    values = [c for c in table.columns if c not in on and c != weight]
    if clash := set(values) & set(df.columns):
        raise ValueError(f"looked-up columns exist already: {sorted(clash)}")
    table = materialize(table, "lookup")
    taken = [*df.columns, *table.columns]
    mine = {k: fresh_name(taken, f"key_{i}") for i, k in enumerate(on)}
    salt = fresh_name(taken, "salt")
    side = table.select(*[quoted(k).alias(m) for k, m in mine.items()], quoted(weight).alias(salt), *[quoted(v) for v in values])
    keys = list(mine.values())
    rows = df.withColumns({mine[k]: e for k, e in on.items()})
    order = [quoted(c) for c in (*df.columns, *values)]
    if is_small(table, broadcast_rows, broadcast_bytes):
        return rows.join(F.broadcast(side.drop(salt)), keys, "left").select(order)
    total = side.agg(F.sum(salt)).first()[0] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(*keys)
    heavy = [r[0] for r in side.where(F.col(salt) > F.lit(total / (4 * tasks))).select(hashed).collect()]
    hot = hashed.isin(heavy) if heavy else F.lit(False)
    whole = all_of([F.col(k).isNotNull() for k in keys])
    place = F.when(~whole, F.pmod(_spread(df), F.lit(NULL_SALTS))).when(hot, F.pmod(_spread(df), F.lit(SALTS))).otherwise(0)
    copies = F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(SALTS - 1)).otherwise(0).cast("long"))
    side = side.withColumn(salt, F.explode(copies)).hint("merge")
    return rows.withColumn(salt, place.cast("long")).join(side, [*keys, salt], "left").select(order)


def left_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a large table with unique keys, in one shuffle. Rows with a null key match nothing, so they are
    spread over salts instead of meeting in one partition."""
    values = [c for c in other.columns if c not in keys]
    salt = fresh_name([*df.columns, *other.columns], "salt")
    whole = all_of([quoted(k).isNotNull() for k in keys])
    place = F.when(whole, 0).otherwise(F.pmod(_spread(df), F.lit(NULL_SALTS))).cast("long")
    joined = df.withColumn(salt, place).join(other.withColumn(salt, F.lit(0).cast("long")), [*keys, salt], "left")
    return joined.select([quoted(c) for c in (*df.columns, *values)])
