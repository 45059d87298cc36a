"""Writing splits, reports, fitted parameters and inventories."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import quoted
from tableprep.functions.hashing import row_fingerprint
from tableprep.operators.fitted import MAKERS, Fitted, StepData, Transform

FACT_SCHEMA = "source_column string, strategy string, parameter string, value string"


def write_splits(df: DataFrame, path: str, *, split: str = "split", format: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per split value."""
    df.write.mode(mode).partitionBy(split).format(format).options(header=True).save(path)


def write_table(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(format).options(header=True).save(path)


def write_report(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """JSON lines in UTF-8, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path)


def fitted_parameters(spark: SparkSession, steps: list[Fitted]) -> DataFrame:
    """The small parameters of fitted transforms as a table."""
    return spark.createDataFrame([f for step in steps for f in step.facts], FACT_SCHEMA)


def feature_report(spark: SparkSession, steps: list[Fitted], result: DataFrame) -> DataFrame:
    """(feature, source_column, transform, data_type) of every feature the transforms made."""
    types = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    rows = []
    for step in steps:
        strategies = {f[0]: f[1] for f in step.facts}
        for source, names in step.outputs.items():
            rows += [(n, source, strategies.get(source, ""), types.get(n, "")) for n in names if n in types]
    return spark.createDataFrame(rows, "feature string, source_column string, transform string, data_type string")


STEP_SCHEMA = "position int, kind string, params string, outputs string, facts array<struct<source_column:string,strategy:string,parameter:string,value:string>>, tables map<string,string>, models map<string,string>"


def write_parameters(spark: SparkSession, steps: list[Fitted], path: str) -> None:
    """Fitted steps as parquet: the small parameters as facts and per step, a folder for each table and each model."""
    fitted_parameters(spark, steps).write.parquet(f"{path}/facts")
    rows = []
    for position, step in enumerate(steps):
        tables = {name: f"tables/{position:03d}-{n}" for n, name in enumerate(step.tables)}
        models = {name: f"models/{position:03d}-{n}" for n, name in enumerate(step.models)}
        for name, table in step.tables.items():
            table.write.parquet(f"{path}/{tables[name]}")
        for name, model in step.models.items():
            model.write().save(f"{path}/{models[name]}")
        texts = (json.dumps(x, ensure_ascii=False, default=str) for x in (step.params, step.outputs))
        rows.append((position, step.kind, *texts, step.facts, tables, models))
    spark.createDataFrame(rows, STEP_SCHEMA).coalesce(1).write.parquet(f"{path}/steps")


def read_steps(spark: SparkSession, path: str, functions: Mapping[str, Transform], *, new_rows: bool) -> list[Fitted]:
    """The steps `write_parameters` wrote, made anew from their data. Custom steps are taken from `functions` by name."""
    steps = []
    for row in sorted(spark.read.parquet(f"{path}/steps").collect(), key=lambda r: r["position"]):  # one row a step of a plan
        params, outputs, facts = json.loads(row["params"]), json.loads(row["outputs"]), [tuple(f) for f in row["facts"]]
        if row["kind"] == "custom":
            if params["name"] not in functions:
                raise ValueError(f"the steps need a function for {params['name']}")
            step = Fitted(functions[params["name"]], facts, kind="custom", params=params)
        else:
            tables = {name: spark.read.parquet(f"{path}/{at}") for name, at in row["tables"].items()}
            models = {name: PipelineModel.load(f"{path}/{at}") for name, at in row["models"].items()}
            step = Fitted(MAKERS[row["kind"]](StepData(params, tables, models, new_rows)), facts, tables, kind=row["kind"], params=params, models=models)
        step.outputs = outputs
        steps.append(step)
    return steps


def artifact_inventory(spark: SparkSession, artifacts: list[dict], folder: str) -> DataFrame:
    """(artifact_type, path, required, exists, length): planned artifacts against what was written.

    An artifact may be a file or a folder of part files; folders count with all they hold.
    """
    schema = T.StructType([
        T.StructField("artifact_type", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("required", T.BooleanType()),
    ])
    planned = spark.createDataFrame(
        [(a["artifact_type"], a["path"], bool(a.get("required", True))) for a in artifacts], schema
    )
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.regexp_replace("path", "^file:/+", "/").alias("full"), "length"
    )
    relative = F.expr(f"substring(full, {len(root) + 2})")
    pieces = F.split(relative, "/")
    # every file counts for itself and for each folder above it, as deep as the file lies
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("pieces")), lambda n: F.array_join(F.slice("pieces", 1, n), "/")
    )
    held = (
        files.withColumn("pieces", pieces).select(F.explode(prefixes).alias("path"), "length")
        .groupBy("path").agg(F.sum("length").alias("length"))
    )
    matched = held.join(F.broadcast(planned.select("path").distinct()), "path", "left_semi")
    joined = planned.join(F.broadcast(matched), "path", "left")  # at most one row per planned path
    return joined.select(
        "artifact_type", "path", "required", F.col("length").isNotNull().alias("exists"),
        F.coalesce("length", F.lit(0)).alias("length"),
    )


def content_hash(df: DataFrame) -> DataFrame:
    """(row_count, content_hash): the same for the same rows in any order and partitioning."""
    h0, h1 = row_fingerprint(df)
    marked = df.select(h0.alias("h0"), h1.alias("h1"))
    high = F.sum(F.pmod("h1", F.lit(1 << 31)).cast("decimal(38,0)"))
    return marked.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.concat_ws("-", F.hex(F.coalesce(F.bit_xor("h0"), F.lit(0))), F.coalesce(high, F.lit(0)).cast("string")).alias("content_hash"),
    )


def digest_sum(df: DataFrame) -> DataFrame:
    """(row_count, digest_sum): a sum of md5 prefixes of the row texts, repeatable in other engines.

    A row's text has every value's length before it, and a bare mark for null, so that neither null and empty nor values
    moved across a border look alike.
    """
    texts = [quoted(c).cast("string") for c in df.columns]
    marked = F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    prefix = F.conv(F.substring(F.md5(marked), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(prefix).alias("digest_sum"))
