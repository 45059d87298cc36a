"""Chat formatting of preference pairs, in DataFrame functions only.

A pair is two conversations, one chosen and one rejected. Their longest common prefix of turns is rendered once as the
prompt; what follows is rendered as two completions, each with a mask: the places, in characters from the start of the
prompt, of the assistant's texts and their end marks, which alone are trained on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.session import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
ROWS_PER_BUCKET = 1000
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id and its turns in order.

    Turns of a null id belong to no conversation and are left out. Turns that share a number follow in order of role
    and text, null first; a null role or text counts as empty.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def swapped_replies(talks: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs for conversations without stated preferences: pair id, chosen, rejected, rejected_from.

    Chosen is a conversation up to its last assistant turn; rejected is the same with that reply taken from another
    conversation, the next one in the order of the md5 of ids within buckets of about a thousand. Conversations without
    an assistant turn, or alone in their bucket, have a null rejected.
    """
    roles = F.transform("turns", lambda t: t["role"])
    last = F.size("turns") - F.array_position(F.reverse(roles), ASSISTANT) + 1
    rows = talks.withColumn("last", F.when(F.array_contains(roles, ASSISTANT), last.cast("int")))
    rows = rows.withColumn("chosen", F.when(F.col("last").isNotNull(), F.slice("turns", 1, F.col("last"))))
    rows = rows.withColumn("reply", F.get("turns", F.col("last") - 1)["text"]).withColumn("order", F.md5(F.col(id_col).cast("string")))
    rows = materialize(rows.drop("turns"), "preference-replies")
    buckets = max(1, math.ceil(rows.count() / ROWS_PER_BUCKET))
    number = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % buckets
    answered = rows.where("last IS NOT NULL").withColumn("bucket", number)
    ring = Window.partitionBy("bucket").orderBy("order", id_col)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(F.col(id_col).alias("id"), F.col("reply").alias("reply"))
    following = F.coalesce(F.lead(other).over(ring), F.first(other).over(whole))
    paired = answered.withColumn("other", F.when(F.count("*").over(whole) > 1, following))
    swapped = F.concat(
        F.slice("chosen", 1, F.col("last") - 1),
        F.array(F.struct(F.lit(ASSISTANT).alias("role"), F.col("other")["reply"].alias("text"))),
    )
    rejected = F.when(F.col("other").isNotNull(), swapped)
    paired = paired.select(id_col, "chosen", rejected.alias("rejected"), F.col("other")["id"].alias("rejected_from"))
    silent = rows.where("last IS NULL").select(id_col, "chosen", F.lit(None).cast(TURNS).alias("rejected"), F.lit(None).cast("long").alias("rejected_from"))
    return paired.unionByName(silent)


def _safe(text: Column) -> Column:
    """Text in which a turn's marks cannot be forged."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column, offset: Column) -> Column:
    """Places of the assistant's texts with their end marks, the first character being at `offset`."""
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(_head(t)).alias("head"), (F.length(_safe(t["text"])) + len(CLOSE)).alias("body"), (t["role"] == ASSISTANT).alias("on"),
    ))
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    start = F.struct(offset.cast("long").alias("at"), nothing.alias("spans"))

    def step(a: Column, s: Column) -> Column:
        begin = a["at"] + s["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + s["body"]).alias("end")))
        return F.struct((begin + s["body"] + 1).alias("at"), F.when(s["on"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Adds status, n_prompt_turns, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask to each pair.

    status is `pair`; `no_pair` where a side is null; `same` where both sides have the same turns; `cut` where one side
    is the beginning of the other, so that one completion is empty. Only `pair` and `cut` rows have texts and masks. Two
    empty conversations are `same`. Marks that stand in a text are set apart by blanks, so they cannot end a turn.
    """
    a, b = F.col(chosen_col), F.col(rejected_col)
    same = F.zip_with(a, b, lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first_off = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    shared = F.when(first_off > 0, first_off - 1).otherwise(F.size(a)).cast("int")
    rows = pairs.withColumn("n_prompt_turns", F.when(a.isNotNull() & b.isNotNull(), shared))
    n = F.col("n_prompt_turns")
    status = (
        F.when(n.isNull(), "no_pair").when((F.size(a) == n) & (F.size(b) == n), "same")
        .when((F.size(a) == n) | (F.size(b) == n), "cut").otherwise("pair")
    )
    rows = rows.withColumn("status", status)
    real = F.col("status").isin("pair", "cut")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    rows = rows.withColumn("prompt", F.when(real, _rendered(F.slice(a, 1, n))))
    offset = F.length("prompt")
    return rows.withColumns({
        "chosen_text": F.when(real, _rendered(rest(a))), "rejected_text": F.when(real, _rendered(rest(b))),
        "chosen_mask": F.when(real, _mask(rest(a), offset)), "rejected_mask": F.when(real, _mask(rest(b), offset)),
    })
