"""Batch jobs over response texts: fenced blocks, embedded JSON and its yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed


def fenced_blocks(text: Column, language: str | None = None) -> Column:
    """Contents of the fenced blocks of a text, trimmed; only those in `language` when given."""
    pattern = fixed.FENCE_PATTERN
    contents = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), strip)
    if language is None:
        return contents
    languages = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    named = F.arrays_zip(languages.alias("language"), contents.alias("content"))
    return F.transform(
        F.filter(named, lambda b: F.lower(b["language"]) == language.lower()), lambda b: b["content"]
    )


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fence(text: Column) -> Column:
    """Without the fence when one fence surrounds the whole text."""
    bare = strip(text)
    whole = r"(?s)^```([A-Za-z0-9_-]*)\s*\n(.*?)```$"
    return F.when(bare.rlike(whole), strip(F.regexp_extract(bare, whole, 2))).otherwise(bare)


# Pieces a text is read by: an escaped character, a quote, a bracket, or a run of anything else.
PIECES = r"(?s)\\.|[\"{}\[\]\\]|[^\"{}\[\]\\]+"
SCAN_STATE = "struct<depth:int,quoted:boolean,taken:int,closed:boolean>"


def balanced_json(text: Column) -> Column:
    """The first balanced object or array; '' when there is none, '!' when it never closes.

    The text from the first bracket on is cut into pieces by one expression, and a fold over them keeps the depth and
    whether a quoted string is open, in which brackets and escaped quotes do not count.
    """
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    start = F.when((brace > 0) & (bracket > 0), F.least(brace, bracket)).otherwise(F.greatest(brace, bracket))
    rest = F.substring(text, start, F.length(text))
    bound = F.struct(rest.alias("rest"), F.substring(rest, F.lit(1), F.lit(1)).alias("opener"))

    def scanned(s: Column) -> Column:
        closer = F.when(s["opener"] == "{", "}").otherwise("]")
        begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("taken"), F.lit(False).alias("closed")).cast(SCAN_STATE)

        def step(so_far: Column, piece: Column) -> Column:
            # a backslash escapes inside of strings only; elsewhere what follows it counts
            counts = F.when(~so_far["quoted"] & piece.startswith("\\"), F.substring(piece, 2, 1)).otherwise(piece)
            opens, closes = ~so_far["quoted"] & (counts == s["opener"]), ~so_far["quoted"] & (counts == closer)
            depth = so_far["depth"] + opens.cast("int") - closes.cast("int")
            after = F.struct(
                depth.alias("depth"), (so_far["quoted"] != (counts == "\"")).alias("quoted"), (so_far["taken"] + F.length(piece)).alias("taken"),
                (closes & (depth == 0)).alias("closed"),
            )
            return F.when(so_far["closed"], so_far).otherwise(after).cast(SCAN_STATE)

        end = F.aggregate(F.regexp_extract_all(s["rest"], F.lit(PIECES), F.lit(0)), begin, step)
        return F.transform(F.array(end), lambda e: F.when(e["closed"], F.substring(s["rest"], F.lit(1), e["taken"])).otherwise("!"))[0]

    return F.when(start == 0, "").when(start > 0, F.transform(F.array(bound), scanned)[0])


def extract_json(df: DataFrame, text: str) -> DataFrame:
    """Add json_text and json_status: ok, none, unbalanced or invalid.

    A json fence wins; else the first balanced object or array of the unfenced text, else of the
    whole text.
    """
    source = F.col(text)
    fenced = F.get(F.filter(fenced_blocks(source, "json"), lambda b: b != ""), F.lit(0))
    bare = strip_fence(source)
    scanned = df.withColumns({
        "__fenced": fenced,
        "__found": F.when(fenced.isNull(), balanced_json(F.when(bare.rlike(r"^[{\[]"), bare).otherwise(source))),
    })
    found = F.col("__found")
    picked = F.coalesce("__fenced", F.when(~found.isin("", "!"), found))
    status = (
        F.when(F.col("__fenced").isNull() & (F.coalesce(found, F.lit("")) == ""), "none")
        .when(found == "!", "unbalanced")
        .when(F.try_parse_json(picked).isNull(), "invalid")
        .otherwise("ok")
    )
    return scanned.withColumns({"json_text": picked, "json_status": status}).drop("__fenced", "__found")


def json_yield(df: DataFrame, by: list[str]) -> DataFrame:
    """Responses and usable responses per group of an extract_json result."""
    ok = F.col("json_status") == "ok"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"), F.count_if(ok).alias("usable"), F.avg(ok.cast("double")).alias("yield")
    )
