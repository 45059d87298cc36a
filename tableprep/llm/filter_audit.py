"""Filter interaction audit: what every filter removes in every order, from folds over a small array of orders.

Documents are counted by cell first: part, which filters they fail (a mask), and their labels. Each cell then folds
across the array of all orders with `transform` and `aggregate`, which gives one struct a (order, step), weighted by the
cell's count, and the structs of a part's cells are summed place by place. Nothing is folded per document.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.joins import left_join
from tableprep.llm.common import WORD

COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure condition of each filter that one text decides; text must not be null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # bound once as a lambda's variable: the words are used twice
    few, repeats = (F.transform(F.array(words), f)[0] for f in (
        lambda w: F.size(w) < 100, lambda w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
    ))
    return {
        "A": few,
        "B": repeats,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def bits(fails: Mapping[str, Column], letters: str) -> Column:
    """One bit a filter, in the order of the letters."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails[c], 1 << letters.index(c)).otherwise(0) for c in fails])


def text_digest(text: Column) -> Column:
    """256 bits that stand for the text."""
    return F.unhex(F.sha2(text, 256))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows with `good` and `toxic`: whether any label of their id says quality 1, or toxic 1. No label says neither."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    found = left_join(docs, said, ["id"])
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def cells(
    docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just these filters, at most 128 rows a part.

    Copies are found without bringing a text's rows together: rows are summed by (digest, part, labels) before they
    shuffle, and only the smallest id of each sum and the rows that hold it travel on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("body")
    ).select("id", "part", bits(text_filters(F.col("body")), letters).alias("mask"), text_digest(F.col("body")).alias("digest"))
    group = ["digest", "part", "mask", "good", "toxic"]
    same_id = labelled(rows, labels, id_col).groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    summed = same_id.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("unnamed"), F.min(least).alias("least"))
    # at most a few rows a digest by now: one for each part and pair of labels its copies have
    first = summed.groupBy("digest").agg(F.min("least.id").alias("first_id")).withColumnRenamed("digest", "own")
    joined = summed.join(first.hint("merge"), F.col("digest") == F.col("own"))
    originals = F.coalesce("unnamed", F.lit(0)) + F.when(F.col("least.id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    copy = F.col("mask").bitwiseOR(F.lit(1 << letters.index(COPY)))
    both = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct(copy.alias("mask"), (F.col("n") - originals).alias("n")))
    return joined.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(letters: str) -> list[str]:
    """Every order of the filters."""
    return ["".join(p) for p in permutations(letters)]


def _fails(mask: Column, letters: str, letter: Column) -> Column:
    return F.getbit(mask, F.position(letter, F.lit(letters)) - 1) == 1


def folded(letters: str, mask: Column, good: Column, toxic: Column, n: Column) -> Column:
    """One struct for each order and step, in the orders' order, with what the n documents of a cell add to its counts."""
    per_step = "struct<alive:boolean,steps:array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>>"
    start = F.struct(F.lit(True).alias("alive"), F.array().alias("steps")).cast(per_step)
    none, whole = F.lit(0).cast("long"), n.cast("long")

    def apply_one(order: Column):
        def step(so_far: Column, place: Column) -> Column:
            letter = F.substring(order, place, F.lit(1))
            fails, alive = _fails(mask, letters, letter), so_far["alive"]
            removed = alive & fails
            weighed = {
                "kept": alive & ~fails, "removed": removed, "redundant": ~alive & fails,
                "unique_fails": fails & (F.bit_count(mask) == 1), "good_lost": removed & good, "toxic_lost": removed & toxic,
            }
            here = F.struct(*[F.when(c, whole).otherwise(none).alias(k) for k, c in weighed.items()])
            return F.struct((alive & ~fails).alias("alive"), F.concat(so_far["steps"], F.array(here)).alias("steps")).cast(per_step)

        return step

    places = F.sequence(F.lit(1), F.lit(len(letters)))
    every = F.array(*[F.lit(o) for o in orders(letters)])
    return F.flatten(F.transform(every, lambda order: F.aggregate(places, start, apply_one(order), lambda done: done["steps"])))


def audit(
    docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, filter_order, step, the counts, shapley, filter): one row for every part, order of the filters and step.

    `shapley` is what the step's filter removes within the part, summed over all orders, at any step. Null texts are
    empty, a null part is the empty string. Rows without an id are never a copy of another and make no row one; rows
    that share id and text are no copies of each other, as neither id is smaller. An id with several labels has each
    that any of them gives. An empty table has no parts, so no rows. Other columns are ignored, whatever their names.
    """
    counted = cells(docs, labels, letters, id_col=id_col, text_col=text_col, part_col=part_col)
    structs = folded(letters, F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"))
    summed = counted.select("part", F.posexplode(structs).alias("place", "cell")).groupBy("part", "place").agg(
        *[F.sum(F.col("cell")[c]).alias(c) for c in COUNTS]
    )
    size = len(letters)
    order = F.element_at(F.array(*[F.lit(o) for o in orders(letters)]), F.floor(F.col("place") / size).cast("int") + 1)
    step = F.col("place") % size + 1
    placed = summed.select(
        "part", order.alias("filter_order"), step.cast("int").alias("step"), F.substring(order, step, F.lit(1)).alias("filter"), *COUNTS
    )
    shares = placed.groupBy(F.col("part").alias("own_part"), F.col("filter").alias("own_filter")).agg(F.sum("removed").alias("shapley"))
    same = (F.col("part") == F.col("own_part")) & (F.col("filter") == F.col("own_filter"))
    return placed.join(shares, same).select("part", "filter_order", "step", *COUNTS, "shapley", "filter")
