"""Line dedup across documents: levelled sorted runs of line hashes, compacted as they come in.

The index is a set of runs: tables of (key, docs, keep_id, first) bucketed and sorted by the 128-bit hash of a line's
key. A batch of lines is counted by key, meets every live run in a merge join without shuffling it, and is written as a
run of its own: `first` marks the keys no earlier run holds (the anti-join). Once a level has FANOUT runs, they become
one run of the next level, so a batch meets few runs, however many came before. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import fresh_name, quoted
from tableprep.functions.joins import lookup
from tableprep.session import materialize, scratch_path

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 6
FANOUT = 3
# A table of recurring lines up to this many rows is broadcast (24 bytes each); beyond it, lines meet it by a shuffle.
BROADCAST_LINES = 100_000

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "key binary, docs long, keep_id long, first boolean"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(lines: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Per line the md5 of its key as bytes, null where the key has fewer than `least_chars` code points.

    A key is the line stripped of blanks at both ends, with A-Z lower-cased (in ASCII that is all `lower` does).
    """
    bare = F.transform(lines, lambda line: F.btrim(line, F.lit(BLANKS)))

    def hashed(line: Column) -> Column:
        ascii_only = F.octet_length(line) == F.char_length(line)
        key = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
        return F.when(F.char_length(line) >= least_chars, F.unhex(F.md5(key)))

    return F.transform(bare, hashed)


def row_mark(text: Column) -> Column:
    """128 bits that tell the texts of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, mark, key, pos, fresh): every line long enough; `fresh` is true for one line of each key of a row."""
    placed = F.transform(line_hashes(lines_of(quoted(text_col)), least_chars), lambda key, pos: F.struct(key.alias("key"), pos.alias("pos")))
    ordered = F.sort_array(F.filter(placed, lambda e: e["key"].isNotNull()))
    # bound once as a lambda's variable, so that the array is not made anew for every element
    flagged = F.transform(F.array(ordered), lambda a: F.transform(a, lambda e, i: F.struct(
        e["key"].alias("key"), e["pos"].alias("pos"), (~F.get(a, i - 1)["key"].eqNullSafe(e["key"])).alias("fresh"),
    )))
    # the mark is made before the lines unfold, else it would be made for every line
    rows = docs.select(quoted(id_col).cast("long").alias("id"), row_mark(quoted(text_col)).alias("mark"), flagged[0].alias("entries"))
    return rows.select("id", "mark", F.inline("entries"))


class LineRuns:
    """The runs of one index, by level. Every run is a written table in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    @property
    def live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of lines (key, id, fresh), one `fresh` line for each document and key.

        Returns the batch's own run: `first` says that no earlier batch holds the key, and only then keep_id is set, to
        the largest id of the batch that holds it.
        """
        own = lines.where("fresh").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep_id"))
        live, marks = self.live, []
        for n, name in enumerate(live):
            marks.append(F.col(f"in_{n}"))
            held = self.spark.table(name).where("first").select("key", F.lit(True).alias(f"in_{n}"))
            own = own.join(held.hint("merge"), "key", "left")
        first = ~F.coalesce(*marks, F.lit(False))
        name = self._write(own.select("key", "docs", F.when(first, F.col("keep_id")).alias("keep_id"), first.alias("first")))
        self.levels[0].append(name)
        self._compact()
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.paths[name])

    def _compact(self) -> None:
        """Full levels become one run of the next; the files of a merged run stay, its name goes."""
        for level, names in enumerate(self.levels):
            if len(names) < self.fanout:
                return
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(names)))
            self.levels[level] = []
            self._unname(names)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each key of some runs; at most one of them holds it first.

        The files are read as they are, not as buckets: a union of bucketed tables claims their partitioning, but does
        not keep it.
        """
        every = self.spark.read.schema(RUN_SCHEMA).parquet(*[self.paths[n] for n in names])
        return every.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("keep_id").alias("keep_id"), F.max("first").alias("first"))

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "line-run")
        run.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def totals(self) -> DataFrame:
        """(key, docs, keep_id) over all batches."""
        return self._merged(self.live).drop("first")

    def forget(self) -> None:
        """Take the runs out of the session's catalog."""
        self._unname(self.live)
        self.levels = [[]]

    def _unname(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _dealt(lines: DataFrame, docs: DataFrame, id_col: str, batches: int) -> DataFrame:
    """The lines with a batch number, written once by batch; no batch has larger ids than the one before, null ids come last."""
    steps = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(quoted(id_col).cast("long"), steps)).first()[0] if steps else []
    after = [F.when(F.col("id") >= c, 0).otherwise(1) for c in sorted(set(cuts or []))]
    batch = reduce(lambda a, b: a + b, after, F.lit(0))
    path = scratch_path(lines.sparkSession, "lines")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    return lines.sparkSession.read.schema(T.StructType([*lines.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """(id, mark, positions): the places of the lines to drop, per id and text that has any.

    Batches come with falling ids, so the batch that holds a key first knows the largest id that holds it. `batches` and
    `fanout` change the cost only.
    """
    spark = docs.sparkSession
    lines = _dealt(line_table(docs, id_col, text_col, least_chars), docs, id_col, batches)
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    common = materialize(runs.totals().where(F.col("docs") >= least_docs).withColumn("common", F.lit(True)), "common-lines")
    runs.forget()
    found = lookup(lines.drop("batch", "fresh"), common, ["key"], weight="docs", broadcast_rows=BROADCAST_LINES)
    gone = found.where(F.col("common") & ~F.col("id").eqNullSafe(F.col("keep_id")))
    # equal rows have equal places, so a group's set is never larger than its text has lines
    return gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def without(lines: Column, positions: Column) -> Column:
    """The lines but for those at the positions: both are sorted by place, and a line that follows a mark of its place goes."""
    line = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("kind"), x.alias("line")))
    mark = F.transform(positions, lambda p: F.struct(p.alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))
    both = F.transform(F.array(F.sort_array(F.concat(mark, line))), lambda a: F.filter(
        a, lambda e, i: (e["kind"] == 1) & ~F.coalesce((F.get(a, i - 1)["kind"] == 0) & (F.get(a, i - 1)["pos"] == e["pos"]), F.lit(False))
    ))
    return F.transform(both[0], lambda e: e["line"])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: the id, n_lines (before), n_dropped, and kept_text, the other lines joined again.

    A line whose key has 40 code points or more and stands in five documents or more stays in the largest id that holds
    it only. Every row is a document: rows that repeat id and text count each, and get the same result; rows of the
    largest id all keep the line. Null ids come after all others, so they keep a line only where no row with an id holds
    it. Null and empty texts are one empty line, which stays. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("own_id"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    return _cut(rows, recurring_lines(docs, id_col, text_col, **options), "own_id", "body").select(
        F.col("own_id").alias(id_col), "n_lines", "n_dropped", F.coalesce("kept_text", "body").alias("kept_text")
    )


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their columns, recurring lines taken out of the texts; see `line_report`. Null texts stay null."""
    gone = recurring_lines(docs, id_col, text_col, **options)
    names = {n: fresh_name(docs.columns, n) for n in ("id", "mark", "positions", "n_lines", "n_dropped", "kept_text")}
    cut = _cut(docs, gone, id_col, text_col, names)
    text = F.coalesce(quoted(names["kept_text"]), quoted(text_col)).alias(text_col)
    return cut.select(*[text if c == text_col else quoted(c) for c in docs.columns])


def _cut(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, names: dict[str, str] | None = None) -> DataFrame:
    """The rows with n_lines, n_dropped and kept_text (null where no line goes), under the given names."""
    names = names or {n: n for n in ("id", "mark", "positions", "n_lines", "n_dropped", "kept_text")}
    gone = gone.select(*[F.col(n).alias(names[n]) for n in ("id", "mark", "positions")])
    own, mark, at = (quoted(names[n]) for n in ("id", "mark", "positions"))
    same = quoted(id_col).cast("long").eqNullSafe(own) & (row_mark(quoted(text_col)) == mark)
    lines = lines_of(quoted(text_col))
    return docs.join(gone, same, "left").withColumns({
        names["n_lines"]: F.size(lines).cast("long"),
        names["n_dropped"]: F.when(at.isNull(), 0).otherwise(F.size(at)).cast("long"),
        names["kept_text"]: F.when(at.isNotNull(), F.array_join(without(lines, at), "\n")),
    })
