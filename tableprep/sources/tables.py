"""Reading tables by suffix, listing table files and describing what was read."""

from __future__ import annotations

import codecs
import re
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep import fixed_values as fixed
from tableprep.functions.columns import quoted

SUFFIXES = (
    fixed.CSV_SUFFIXES + fixed.TAB_SUFFIXES + fixed.JSON_SUFFIXES + fixed.JSON_LINES_SUFFIXES + fixed.PARQUET_SUFFIXES
)


def suffix_of(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def charset(encoding: str) -> str:
    """The reader's name for an encoding: latin1 is iso-8859-1, ascii is us-ascii."""
    name = codecs.lookup(encoding).name.replace("iso8859", "iso-8859")
    return "us-ascii" if name == "ascii" else name


# Kinds a column of texts is tried as, in order, with the shape its texts must have.
_KINDS = (
    ("int", r"^\s*[+-]?\d+\s*$"),
    ("bigint", r"^\s*[+-]?\d+\s*$"),
    ("double", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"),
    ("boolean", r"^(?i)(true|false)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
)


def typed(df: DataFrame) -> DataFrame:
    """Every column of texts cast to the narrowest kind that all its values have; found by one aggregate."""

    def fits(name: str, kind: str, shape: str) -> Column:
        value = quoted(name)
        return value.isNull() | (value.rlike(shape) & value.try_cast(kind).isNotNull())

    checks = [F.bool_and(fits(c, k, s)) for c in df.columns for k, s in _KINDS]
    found = list(df.agg(*[F.count(quoted(c)) for c in df.columns], *checks).first()) if df.columns else []
    kinds: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        fitting = found[len(df.columns) + i * len(_KINDS) :][: len(_KINDS)]
        kinds[c] = next((k for (k, _), ok in zip(_KINDS, fitting) if ok and found[i]), "string")
    return df.select([quoted(c).cast(k).alias(c) for c, k in kinds.items()])


def load_table(
    spark: SparkSession, path: str, *, encoding: str = "utf-8", schema: str | None = None,
    missing: tuple[str, ...] | None = fixed.MISSING_TOKENS, **options: Any,
) -> DataFrame:
    """A lazy table from a csv, tsv, txt, json, jsonl, ndjson or parquet path.

    Options go to the Spark reader. A `schema` spares the pass that infers types. In delimited files the texts in
    `missing` (None: none) are missing values, and quoted line breaks belong to their value. Files without such breaks
    are read in splits; one scan of the lines tells, which an explicit `multiLine` spares.
    """
    suffix = suffix_of(path)
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported data file extension: {suffix}. Supported extensions: {sorted(SUFFIXES)}")
    encoding = charset(encoding)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if suffix in fixed.PARQUET_SUFFIXES:
            return reader.options(**options).parquet(path)
        if suffix in fixed.JSON_SUFFIXES:
            return reader.options(**{"multiLine": True, "encoding": encoding, **options}).json(path)
        if suffix in fixed.JSON_LINES_SUFFIXES:
            return reader.options(**{"encoding": encoding, **options}).json(path)
        layout = {"header": True, "encoding": encoding, "escape": '"', "multiLine": True}
        if not {"multiline", "quote"} & {o.lower() for o in options}:
            layout["multiLine"] = _breaks_in_quotes(spark, path, encoding)
        if suffix in fixed.TAB_SUFFIXES:
            layout["sep"] = "\t"
        df = reader.options(**{**layout, **options}).csv(path)
        texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        if missing is not None:
            df = df.select([F.when(~quoted(c).isin(*missing), quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])
        return typed(df) if schema is None and "inferSchema" not in options else df
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Data file not found: {path}") from error
        raise


def _breaks_in_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether any line has an odd number of quotes, so that a quoted value goes on in the next. Lines of encodings whose
    line breaks are no single bytes cannot be told; they may have some."""
    if codecs.encode("\n", encoding) != b"\n":
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def load_tables(spark: SparkSession, paths: list[str], **options: Any) -> DataFrame:
    """Several files as one table; columns a file lacks are null."""
    if not paths:
        raise ValueError(fixed.PLAN_ERRORS["input_files"])
    parts = [load_table(spark, p, **options) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def as_table(spark: SparkSession, data: DataFrame | str, **options: Any) -> tuple[DataFrame, str, str]:
    """(table, name, source_type) of a DataFrame or a path."""
    if isinstance(data, DataFrame):
        return data, "dataframe", "dataframe"
    if isinstance(data, (str, PurePosixPath)):
        return load_table(spark, str(data), **options), PurePosixPath(str(data)).name, "path"
    raise TypeError("data must be a DataFrame or a path.")


def table_metadata(df: DataFrame, path: str) -> DataFrame:
    """One row: path, name, suffix, bytes on disk, shape, column names and types."""
    fields = df.schema.fields
    files = (
        df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .groupBy("file").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    )
    return files.agg(
        F.lit(path).alias("path"),
        F.lit(PurePosixPath(path).name).alias("file_name"),
        F.lit(suffix_of(path)).alias("file_extension"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("file_size_bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.lit(len(fields)).alias("column_count"),
        F.array(*[F.lit(f.name) for f in fields]).alias("columns"),
        F.array(*[F.lit(f.dataType.simpleString()) for f in fields]).alias("dtypes"),
    )


def _root(spark: SparkSession, directory: str) -> str:
    """The path of a directory as files give theirs, without a trailing slash."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        raise FileNotFoundError(f"Directory not found: {directory}")
    if not system.getFileStatus(folder).isDirectory():
        raise NotADirectoryError(f"Not a directory: {directory}")
    return re.sub("^file:/+", "/", system.makeQualified(folder).toString()).rstrip("/")


def _table_paths(files: DataFrame, path: Column, root: str, recursive: bool, *columns: str) -> DataFrame:
    """(path, columns) of files under `root` that belong to a table: one, or in a folder whose name has a table's suffix."""
    inner = F.substring(F.regexp_replace(path, "^file:/+", "/"), len(root) + 2, 1 << 30)
    kinds = "|".join(re.escape(s) for s in SUFFIXES)
    folders = "(?:[^/]+/)*?" if recursive else ""
    found = F.regexp_extract(inner, rf"^({folders}[^/]*(?i:{kinds}))(?:/|$)", 1)
    return files.where(found != "").select(F.concat(F.lit(root + "/"), found).alias("path"), *columns)


def list_table_files(spark: SparkSession, directory: str, *, recursive: bool = False) -> DataFrame:
    """(path, file_name, suffix, length) of the tables under a directory, by path: files, and folders written as one table.

    Only names and sizes are read; the file contents are pruned from the scan.
    """
    root = _root(spark, directory)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    files = _table_paths(listed, F.col("path"), root, recursive, "length").groupBy("path").agg(F.sum("length").alias("length"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), suffix.alias("suffix"), "length").orderBy("path")


def parquet_row_counts(spark: SparkSession, directory: str, *, recursive: bool = False) -> DataFrame:
    """(path, row_count) of the parquet tables under a directory, whatever their columns: one scan that reads none of them."""
    nothing = T.StructType([T.StructField("__none", T.IntegerType())])
    files = spark.read.schema(nothing).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(directory)
    counted = files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    tables = _table_paths(counted, F.col("path"), _root(spark, directory), recursive, "n")
    return tables.groupBy("path").agg(F.sum("n").alias("row_count"))
