"""Reading the test tables and the SQL pieces several checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

# The flat tables and the type class of their columns, for the SQL side of profile checks.
TABLES: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "integer"), ("r_name", "string")],
    "nation": [("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")],
    "customer": [
        ("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"),
        ("c_mktsegment", "string"),
    ],
    "supplier": [("s_suppkey", "integer"), ("s_name", "string"), ("s_nationkey", "integer"), ("s_acctbal", "float")],
    "part": [
        ("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "integer"), ("p_retailprice", "float"),
    ],
    "orders": [
        ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
        ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"),
        ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime"),
    ],
    "events": [
        ("event_id", "integer"), ("ts", "datetime"), ("user_id", "integer"), ("event_type", "string"),
        ("value", "float"), ("props", "string"),
    ],
    "documents": [
        ("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer"),
    ],
    "labels": [("doc_id", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "integer"), ("turn", "integer"), ("role", "string"), ("text", "string")],
    "pages": [("page_id", "integer"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "integer"), ("text", "string")],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Gaps both engines can make alike: the test tables have none of their own.
EVENTS_GAPS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
LABELLED = "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
LABELLED_COLUMNS = [*TABLES["documents"], ("quality", "integer")]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", f"{EVENTS_GAPS} AS value")


def iso_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} = date_trunc('second', {value}) THEN strftime({value}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({value}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def profile_sql(source: str, dataset: str, columns: list[tuple[str, str]], samples: int = 5) -> str:
    """A profile of `source` (a table or a query in parentheses), one row per column."""
    parts = []
    for i, (name, kind) in enumerate(columns):
        numbers = "NULL::DOUBLE AS num_min, NULL::DOUBLE AS num_max, NULL::DOUBLE AS num_mean, NULL::DOUBLE AS num_median, NULL::DOUBLE AS num_std"
        if kind in ("integer", "float"):
            numbers = (
                f"min({name})::DOUBLE AS num_min, max({name})::DOUBLE AS num_max, round(avg({name}), 4) AS num_mean, "
                f"round(median({name}), 4) AS num_median, round(stddev_samp({name}), 4) AS num_std"
            )
        times = "NULL::VARCHAR AS datetime_min, NULL::VARCHAR AS datetime_max"
        if kind == "datetime":
            times = f"{iso_sql(f'min({name})')} AS datetime_min, {iso_sql(f'max({name})')} AS datetime_max"
        picked = f"(SELECT list(v::VARCHAR) FROM (SELECT DISTINCT {name} AS v FROM {source} WHERE {name} IS NOT NULL ORDER BY v LIMIT {samples}))"
        parts.append(
            f"SELECT '{dataset}' AS dataset_name, {i} AS position, '{name}' AS name, '{kind}' AS type_class, "
            f"count(*) AS row_count, count({name}) AS non_null_count, count(*) - count({name}) AS missing_count, "
            f"CASE WHEN count(*) = 0 THEN 0.0 ELSE round_even((count(*) - count({name}))::DOUBLE / count(*), 6) END AS missing_rate, "
            f"count(DISTINCT {name}) AS unique_count, "
            f"CASE WHEN count({name}) = 0 THEN 0.0 ELSE round_even(count(DISTINCT {name})::DOUBLE / count({name}), 6) END AS unique_rate, "
            f"{numbers}, {str(kind == 'datetime').lower()} AS has_datetime_summary, {times}, {picked} AS sample_values FROM {source}"
        )
    return " UNION ALL ".join(parts)
