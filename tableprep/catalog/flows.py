"""Registered queries: sources, sinks and whole plans from profile to prepared rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableprep.catalog.common import EVENTS_GAPS, LABELLED, TABLES, events_with_gaps, labelled_documents, read
from tableprep.catalog.transforms import SEGMENTS
from tableprep.operators import profile, remedies, text
from tableprep.plans import assess, execute
from tableprep.operators.roles import Task
from tableprep.session import scratch_path
from tableprep.sources import sinks, tables

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDER_TYPES = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
ORDERS = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"
)


def orders(s, d):
    return read(s, d, "orders").select(*ORDER_COLUMNS)


def _dated(df):
    """Orders with their date, which must have been read as a time, as text that all engines write alike."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "o_orderdate" else F.col(c) for c in ORDER_COLUMNS])


def scan_csv_gaps(s, d):
    """Gaps written as NA and the like, quoted line breaks, quotes and separators in texts."""
    path = scratch_path(s, "documents") + ".csv"
    gaps = F.when(F.col("doc_id") % 3 == 0, "NA").when(F.col("doc_id") % 3 == 1, "null").otherwise("N/A")
    rows = read(s, d, "documents").select(
        "doc_id", F.concat(F.lit('"a", '), "text").alias("text"), F.when(F.col("lang") == "es", gaps).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") % 5 == 0, gaps).otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
    )
    rows.write.options(header=True, escape='"').csv(path)
    return tables.load_table(s, path).withColumn("n_chars", F.col("n_chars") + 1)


def scan_csv_profile(s, d):
    """The profile of a table that went through a delimited file."""
    path = scratch_path(s, "customer") + ".csv"
    read(s, d, "customer").write.options(header=True, escape='"').csv(path)
    rows = profile.column_profile(tables.load_table(s, path), "customer")
    return rows.select("name", "type_class", "non_null_count", "missing_count", "unique_count", F.round("num_mean", 4).alias("num_mean"))


def scan_csv(s, d):
    path = scratch_path(s, "orders") + ".csv"
    orders(s, d).write.option("header", True).csv(path)
    return _dated(tables.load_table(s, path))


def scan_tsv(s, d):
    path = scratch_path(s, "orders") + ".tsv"
    orders(s, d).write.options(header=True, sep="\t").csv(path)
    return _dated(tables.load_table(s, path))


def scan_txt_semicolon(s, d):
    path = scratch_path(s, "orders") + ".txt"
    orders(s, d).write.options(header=True, sep=";").csv(path)
    return _dated(tables.load_table(s, path, sep=";", schema=ORDER_TYPES))


def scan_json(s, d):
    """Array documents of at most 1,000 records each, one per file."""
    path = scratch_path(s, "orders") + ".json"
    grouped = orders(s, d).groupBy(F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.collect_list(F.struct(*ORDER_COLUMNS)).alias("rows"))
    grouped.select("part", F.to_json("rows").alias("value")).write.partitionBy("part").text(path)
    return _dated(tables.load_table(s, path))


def scan_jsonl(s, d):
    path = scratch_path(s, "orders") + ".jsonl"
    orders(s, d).write.json(path)
    return _dated(tables.load_table(s, path))


def scan_parquet(s, d):
    return tables.load_table(s, f"{d}/orders.parquet").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


def scan_many(s, d):
    """Two files with different columns as one table."""
    path = scratch_path(s, "customers") + ".csv"
    read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment").write.option("header", True).csv(path)
    other = scratch_path(s, "suppliers") + ".parquet"
    read(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")).write.parquet(other)
    return tables.load_tables(s, [path, other]).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("balance"), 2).alias("balance")
    )


def table_metadata(s, d):
    path = f"{d}/lineitem.parquet"
    out = tables.table_metadata(read(s, d, "lineitem"), path)
    return out.select("file_name", "file_extension", "row_count", "column_count", F.array_join("columns", ",").alias("columns"), (F.col("file_size_bytes") > 0).alias("has_bytes"))


def list_files(s, d):
    """The files of the tables, with the rows that each holds."""
    files = tables.list_table_files(s, d).join(tables.parquet_row_counts(s, d), "path", "left")
    return files.select("file_name", "suffix", (F.col("length") > 0).alias("has_bytes"), "row_count")


def sink_splits(s, d):
    path = scratch_path(s, "splits")
    rows = execute.apply_split(orders(s, d), {"strategy": "random", "train_size": 0.8, "test_size": 0.2}, ["o_orderkey"], {})
    sinks.write_splits(rows, path)
    return s.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def sink_report(s, d):
    path = scratch_path(s, "report")
    counted = read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("highest"))
    sinks.write_report(counted, path)
    sinks.write_report(counted.where("event_type = 'error'"), path)
    return s.read.schema("event_type string, events bigint, highest double").json(path)


def content_digest(s, d):
    return sinks.digest_sum(read(s, d, "customer").withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal")).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))))


def content_hash(s, d):
    return sinks.content_hash(read(s, d, "lineitem"))


def labelled(s, d):
    return remedies.drop_missing_target(labelled_documents(s, d), "quality")


def labelled_plan(s, d):
    return assess.assess(labelled(s, d), "labelled", Task("classification", "quality")).plan("labelled", ["documents.parquet", "labels.parquet"])


def plan_apply_labelled(s, d):
    """Default plan on labelled documents: one-hot languages, scaled lengths, TF-IDF texts, stratified split."""
    done = execute.prepare(labelled(s, d), labelled_plan(s, d))
    flags = [c for c in done.rows.columns if c.startswith("lang_")]
    return done.rows.groupBy("split", "quality").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("n_chars"), 3).alias("n_chars"),
        F.sum("source_src3").alias("source_src3"), *[F.sum(c).alias(c) for c in sorted(flags)],
    )


LABELLED_SPLIT = f"""
SELECT *, CASE WHEN r < floor(n * 0.7 + 0.5) THEN 'train' WHEN r < floor(n * 0.85 + 0.5) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, rank() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) - 1 AS r, count(*) OVER (PARTITION BY quality) AS n
FROM ({LABELLED}) WHERE quality IS NOT NULL)
"""


def plan_apply_lineitem(s, d):
    """Default regression plan: random split on the ids, standardised numbers, one-hot flags, date parts."""
    df = read(s, d, "lineitem")
    plan = assess.assess(df, "lineitem", Task("regression", "l_extendedprice")).plan("lineitem", ["lineitem.parquet"])
    done = execute.prepare(df, plan)
    return done.rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.avg("l_discount"), 4).alias("l_discount"), F.round(F.avg("l_tax"), 4).alias("l_tax"),
        F.sum("l_returnflag_A").alias("l_returnflag_A"), F.sum("l_shipdate_year").alias("years"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


# every name that ends in key or number is an id, so four columns identify a line
LINE_SPLIT = """
SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *,
('0x' || substr(md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM lineitem)
"""


def plan_apply_events(s, d):
    """A forecasting plan: carry values forward per user, cyclical time, frequency-coded types, split by time."""
    plan = {
        "plan_name": "events", "status": "executable", "task_type": "forecasting", "input_files": ["events.parquet"],
        "target_column": "value", "time_column": "ts", "id_columns": ["user_id"], "feature_columns": ["event_type"],
        "missing_value_plan": [{"columns": ["value"], "strategy": "ffill"}],
        "categorical_encoding_plan": [{"columns": ["event_type"], "encoding": "frequency"}],
        "datetime_processing_plan": [{"columns": ["ts"], "method": "sort_index"}],
        "split_strategy": {"strategy": "time_based", "time_column": "ts", "train_size": 0.8, "test_size": 0.2},
        "output_artifacts": [{"artifact_type": "full_processed_data", "path": "events"}],
    }
    done = execute.prepare(events_with_gaps(s, d), plan)
    return done.rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("known"), F.round(F.sum("value"), 3).alias("total"),
        F.round(F.avg("event_type"), 6).alias("mean_share"),
    )


def _document_plan(**changes):
    return {
        "plan_name": "documents", "status": "executable", "task_type": "classification", "input_files": ["documents.parquet"],
        "target_column": "source", "id_columns": ["doc_id"], "feature_columns": ["lang", "n_chars", "text"], "split_strategy": {"strategy": "none"},
        "output_artifacts": [{"artifact_type": "full_processed_data", "path": "documents"}], **changes,
    }


def plan_apply_embedding(s, d):
    """A plan whose text step joins vectors: the vectors stay in the result."""
    plan = _document_plan(text_processing_plan=[{"columns": ["text"], "method": "embedding"}])
    vectors = read(s, d, "embeddings")
    done = execute.prepare(
        read(s, d, "documents"), plan,
        functions={"embedding": lambda df: text.join_embeddings(df, vectors, "doc_id", "vec_id", "embedding").drop("text")},
    )
    return done.rows.groupBy("lang", "source", "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("embedding").alias("vectors"), F.sum("n_chars").alias("n_chars"),
        F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("first"),
    )


def plan_apply_drops(s, d):
    """Every way a plan can drop a feature but the date one."""
    plan = _document_plan(
        missing_value_plan=[{"columns": ["n_chars"], "strategy": "drop_column"}], categorical_encoding_plan=[{"columns": ["lang"], "encoding": "drop"}],
        text_processing_plan=[{"columns": ["text"], "method": "drop"}], feature_columns=["lang", "n_chars", "text", "doc_id"], id_columns=[],
    )
    return execute.prepare(read(s, d, "documents"), plan).rows


def plan_apply_custom(s, d):
    """A user's own step in every family; what the steps make stays in the result."""
    plan = _document_plan(
        missing_value_plan=[{"columns": ["n_chars"], "strategy": "custom"}], categorical_encoding_plan=[{"columns": ["lang"], "encoding": "custom"}],
        numeric_scaling_plan=[{"columns": ["n_chars"], "scaling": "custom"}], text_processing_plan=[{"columns": ["text"], "method": "custom"}],
    )
    functions = {
        "missing_value_plan": lambda df: df.withColumn("even", F.col("n_chars") % 2 == 0),
        "categorical_encoding_plan": lambda df: df.withColumn("lang", F.upper("lang")),
        "numeric_scaling_plan": lambda df: df.withColumn("n_chars", F.col("n_chars") * 2),
        "text_processing_plan": lambda df: df.withColumn("bytes", F.octet_length("text")).drop("text"),
    }
    return execute.prepare(read(s, d, "documents"), plan, functions=functions).rows


def plan_apply_dates(s, d):
    """Dropped and custom date columns."""
    plan = {
        "plan_name": "orders", "status": "executable", "task_type": "classification", "input_files": ["orders.parquet"], "target_column": "o_orderstatus",
        "feature_columns": ["o_orderkey", "o_orderdate", "shipped"], "split_strategy": {"strategy": "none"},
        "datetime_processing_plan": [{"columns": ["o_orderdate"], "method": "custom"}, {"columns": ["shipped"], "method": "drop"}],
        "output_artifacts": [{"artifact_type": "full_processed_data", "path": "orders"}],
    }
    own = {"datetime_processing_plan": lambda df: df.withColumn("o_year", F.year("o_orderdate")).drop("o_orderdate")}
    return execute.prepare(read(s, d, "orders").withColumn("shipped", F.col("o_orderdate")), plan, functions=own).rows


def plan_apply_renamed(s, d):
    """A renamed feature is encoded under its new name."""
    plan = {
        "plan_name": "customers", "status": "executable", "task_type": "regression", "input_files": ["customer.parquet"], "target_column": "c_acctbal",
        "feature_columns": ["c_custkey", "c_mktsegment"], "split_strategy": {"strategy": "none"},
        "column_actions": [{"columns": ["c_mktsegment"], "action": "rename", "params": {"c_mktsegment": "segment"}}],
        "categorical_encoding_plan": [{"columns": ["c_mktsegment"], "encoding": "one_hot"}],
        "output_artifacts": [{"artifact_type": "full_processed_data", "path": "customers"}],
    }
    return execute.prepare(read(s, d, "customer"), plan).rows


def _event_plan(**changes):
    return {
        "plan_name": "events", "status": "executable", "task_type": "forecasting", "input_files": ["events.parquet"], "target_column": "value",
        "time_column": "ts", "id_columns": ["user_id"], "drop_columns": ["user_id", "props"], "feature_columns": ["event_type"],
        "split_strategy": {"strategy": "time_based", "time_column": "ts", "train_size": 0.8, "test_size": 0.2},
        "output_artifacts": [{"artifact_type": "full_processed_data", "path": "events"}], **changes,
    }


def _filled_events(direction):
    def query(s, d):
        plan = _event_plan(missing_value_plan=[{"columns": ["value"], "strategy": direction}])
        done = execute.prepare(events_with_gaps(s, d).withColumn("props", F.lit("")), plan, key=["event_id"])
        return done.rows.groupBy("split", "event_type").agg(
            F.count(F.lit(1)).alias("row_count"), F.count("value").alias("known"), F.round(F.sum("value"), 3).alias("total"),
            F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"),
        )

    return query


def _filled_sql(partition, order):
    return (
        f"WITH e AS (SELECT event_id, ts, user_id, event_type, {EVENTS_GAPS} AS value FROM events), "
        "c AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) AS cut FROM e), "
        "t AS (SELECT *, CASE WHEN epoch_us(ts) <= cut THEN 'train' ELSE 'test' END AS split FROM e, c), "
        f"f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t) "
        "SELECT split, event_type, count(*) AS row_count, count(filled) AS known, round(sum(filled), 3) AS total, "
        "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM f GROUP BY split, event_type"
    )


def plan_apply_resample(s, d):
    """A resampled plan keeps its entities, times and aggregates."""
    plan = _event_plan(
        split_strategy={"strategy": "none"},
        datetime_processing_plan=[{"columns": ["ts"], "method": "resample", "params": {"unit": "day", "aggregates": {"events": "count(*)", "highest": "max(value)"}}}],
    )
    return execute.prepare(read(s, d, "events"), plan).rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


def _reloaded(s, done, functions=None):
    """The prepared plan's steps written, and read back in a session of its own."""
    path = scratch_path(s, "preprocessor")
    done.write_preprocessor(path)
    return execute.load_preprocessor(s.newSession(), path, functions)


def plan_reload_lineitem(s, d):
    """The default plan's parameters, fitted on the training rows, applied to all rows as if they were new."""
    df = read(s, d, "lineitem")
    plan = assess.assess(df, "lineitem", Task("regression", "l_extendedprice")).plan("lineitem", ["lineitem.parquet"])
    rows = _reloaded(s, execute.prepare(df, plan)).apply(df)
    return rows.groupBy("l_shipdate_year").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.avg("l_discount"), 4).alias("l_discount"), F.round(F.avg("l_tax"), 4).alias("l_tax"),
        F.sum("l_returnflag_A").alias("l_returnflag_A"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


def plan_reload_encoded(s, d):
    """Fills, an index, shares, target means, flags and hashed texts, applied to rows without the target."""
    plan = {
        "plan_name": "customers", "status": "executable", "task_type": "regression", "input_files": ["customer.parquet"], "target_column": "c_acctbal",
        "id_columns": ["c_custkey"], "feature_columns": ["c_name", "segment", "target", "share", "nation", "gap", "most"],
        "column_actions": [{"columns": ["c_mktsegment"], "action": "rename", "params": {"c_mktsegment": "segment"}}],
        "missing_value_plan": [{"columns": ["gap"], "strategy": "mean"}, {"columns": ["most"], "strategy": "mode"}],
        "categorical_encoding_plan": [
            {"columns": ["segment"], "encoding": "ordinal"}, {"columns": ["target"], "encoding": "target"},
            {"columns": ["share"], "encoding": "frequency"}, {"columns": ["nation"], "encoding": "one_hot", "params": {"output": "vector"}},
        ],
        "numeric_scaling_plan": [{"columns": ["gap"], "scaling": "minmax"}],
        "text_processing_plan": [{"columns": ["c_name"], "method": "tfidf", "params": {"features": 64}}],
        "split_strategy": {"strategy": "random", "train_size": 0.8, "test_size": 0.2},
        "output_artifacts": [{"artifact_type": "preprocessor", "path": "customers"}],
    }
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    df = read(s, d, "customer").withColumns({
        "target": segment, "share": segment, "nation": F.col("c_nationkey"), "gap": F.when(key % 3 != 0, F.col("c_acctbal")),
        "most": F.when(key % 4 != 0, F.col("c_nationkey")),
    })
    rows = _reloaded(s, execute.prepare(df, plan)).apply(df.drop("c_acctbal"))
    spot = vector_to_array("nation_vector")
    return rows.select(
        "segment", F.round("target", 6).alias("target"), F.round("share", 6).alias("share"), F.round("gap", 6).alias("gap"), "most",
        (F.array_position(spot, F.lit(1.0)) - 1).alias("nation"),
    )


RELOAD_SQL = """
WITH c AS (
    SELECT *, CASE WHEN ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split,
        CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS gap, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS most
    FROM customer
),
t AS (SELECT * FROM c WHERE split = 'train'),
a AS (SELECT avg(c_acctbal) AS overall, count(*) AS n, avg(gap) AS mean FROM t),
m AS (SELECT c_mktsegment, (sum(c_acctbal) + 10 * any_value(overall)) / (count(*) + 10) AS target, count(*) / any_value(n) AS share,
    row_number() OVER (ORDER BY c_mktsegment) - 1 AS segment FROM t, a GROUP BY c_mktsegment),
f AS (SELECT min(coalesce(gap, mean)) AS low, max(coalesce(gap, mean)) AS high FROM t, a),
k AS (SELECT most FROM t WHERE most IS NOT NULL GROUP BY most ORDER BY count(*) DESC, most LIMIT 1),
v AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey::VARCHAR) - 1 AS nation FROM t GROUP BY c_nationkey)
SELECT coalesce(segment, -1) AS segment, round(coalesce(target, overall), 6) AS target, round(coalesce(share, 0), 6) AS share,
    round((coalesce(gap, mean) - low) / (high - low), 6) AS gap, coalesce(c.most, k.most) AS most, coalesce(nation, -1) AS nation
FROM c LEFT JOIN m USING (c_mktsegment) LEFT JOIN v USING (c_nationkey), a, f, k
"""


def feature_report(s, d):
    done = execute.prepare(labelled(s, d), labelled_plan(s, d))
    return sinks.feature_report(s, done.steps, done.rows)


def fitted_facts(s, d):
    """Parameters written and read back."""
    df = read(s, d, "lineitem")
    plan = assess.assess(df, "lineitem", Task("regression", "l_extendedprice")).plan("lineitem", ["lineitem.parquet"])
    done = execute.prepare(df, {**plan, "split_strategy": {"strategy": "none"}})
    path = scratch_path(s, "prepared")
    sinks.write_parameters(s, done.steps, path)
    facts = s.read.parquet(f"{path}/facts")
    rounded = F.round(F.expr("try_cast(value AS double)"), 4).cast("string")
    return facts.select("source_column", "strategy", "parameter", F.coalesce(rounded, "value").alias("value"))


def artifact_inventory(s, d):
    df = labelled(s, d)
    plan = labelled_plan(s, d)
    path = scratch_path(s, "prepared")
    execute.prepare(df, plan).write(path)
    planned = [
        {"artifact_type": "full_processed_data", "path": "data"}, {"artifact_type": "train_data", "path": "data/split=train"},
        {"artifact_type": "feature_report", "path": "feature_report"}, {"artifact_type": "preprocessor", "path": "parameters"},
        {"artifact_type": "metadata", "path": "metadata", "required": False}, {"artifact_type": "other", "path": "model.bin"},
    ]
    return sinks.artifact_inventory(s, planned, path).select("artifact_type", "path", "required", "exists")


QUERIES = {
    "scan_csv": (scan_csv, ORDERS),
    "scan_csv_gaps": (
        scan_csv_gaps,
        "SELECT doc_id, '\"a\", ' || text AS text, CASE WHEN lang <> 'es' THEN lang END AS lang, CASE WHEN n_chars % 5 <> 0 THEN n_chars + 1 END AS n_chars FROM documents",
    ),
    "scan_csv_profile": (
        scan_csv_profile,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, '{kind}' AS type_class, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, "
            f"{f'round(avg({c}), 4)' if kind in ('integer', 'float') else 'NULL'}::DOUBLE AS num_mean FROM customer"
            for c, kind in TABLES["customer"]
        ),
    ),
    "scan_tsv": (scan_tsv, ORDERS),
    "scan_txt_semicolon": (scan_txt_semicolon, ORDERS),
    "scan_json": (scan_json, ORDERS),
    "scan_jsonl": (scan_jsonl, ORDERS),
    "scan_parquet": (scan_parquet, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"),
    "scan_many": (
        scan_many,
        "SELECT c_mktsegment, count(*) AS row_count, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment "
        "UNION ALL SELECT NULL, count(*), round(sum(s_acctbal), 2) FROM supplier",
    ),
    "table_metadata": (
        table_metadata,
        f"SELECT 'lineitem.parquet' AS file_name, '.parquet' AS file_extension, count(*) AS row_count, {len(TABLES['lineitem'])} AS column_count, "
        f"'{','.join(c for c, _ in TABLES['lineitem'])}' AS columns, true AS has_bytes FROM lineitem",
    ),
    "list_files": (
        list_files,
        " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, '.parquet' AS suffix, true AS has_bytes, count(*) AS row_count FROM {t}" for t in [*TABLES, "embeddings"]),
    ),
    "sink_splits": (
        sink_splits,
        "SELECT CASE WHEN ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split, "
        "count(*) AS row_count, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1",
    ),
    "sink_report": (
        sink_report,
        "WITH c AS (SELECT event_type, count(*) AS events, max(value) AS highest FROM events GROUP BY event_type) "
        "SELECT * FROM c UNION ALL SELECT * FROM c WHERE event_type = 'error'",
    ),
    "content_digest": (
        content_digest,
        "WITH c AS (SELECT c_custkey::VARCHAR AS a, c_name AS b, c_nationkey::VARCHAR AS c, printf('%.2f', c_acctbal) AS d, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS e FROM customer) "
        "SELECT count(*) AS row_count, sum(('0x' || substr(md5(" + " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in "abcde") + "), 1, 8))::BIGINT)::BIGINT AS digest_sum FROM c",
    ),
    "content_hash": (content_hash, None),
    "plan_apply_labelled": (
        plan_apply_labelled,
        f"WITH t AS ({LABELLED_SPLIT}), m AS (SELECT avg(n_chars) AS a, stddev_samp(n_chars) AS b FROM t WHERE split = 'train') "
        "SELECT split, quality, count(*) AS row_count, round(sum((n_chars - a) / b), 3) AS n_chars, count(*) FILTER (source = 'src3') AS source_src3, "
        + ", ".join(f"count(*) FILTER (lang = '{v}') AS lang_{v}" for v in ("de", "en", "es", "fr")) + " FROM t, m GROUP BY split, quality",
    ),
    "plan_apply_lineitem": (
        plan_apply_lineitem,
        f"WITH t AS ({LINE_SPLIT}), m AS (SELECT avg(l_discount) AS da, stddev_samp(l_discount) AS ds, avg(l_tax) AS ta, stddev_samp(l_tax) AS ts FROM t WHERE split = 'train') "
        "SELECT split, count(*) AS row_count, round(avg((l_discount - da) / ds), 4) AS l_discount, round(avg((l_tax - ta) / ts), 4) AS l_tax, "
        "count(*) FILTER (l_returnflag = 'A') AS \"l_returnflag_A\", sum(year(l_shipdate))::BIGINT AS years, round(sum(l_extendedprice), 2) AS price FROM t, m GROUP BY split",
    ),
    "plan_apply_events": (
        plan_apply_events,
        f"WITH e AS (SELECT event_id, ts, user_id, event_type, {EVENTS_GAPS} AS value FROM events), "
        "c AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) AS cut FROM e), "
        "f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, "
        "CASE WHEN epoch_us(ts) <= cut THEN 'train' ELSE 'test' END AS split FROM e, c), "
        "q AS (SELECT event_type, count(*)::DOUBLE / (SELECT count(*) FROM f WHERE split = 'train') AS share FROM f WHERE split = 'train' GROUP BY event_type) "
        "SELECT split, count(*) AS row_count, count(filled) AS known, round(sum(filled), 3) AS total, round(avg(share), 6) AS mean_share FROM f JOIN q USING (event_type) GROUP BY split",
    ),
    "plan_apply_embedding": (
        plan_apply_embedding,
        "SELECT lang, source, 'full' AS split, count(*) AS row_count, count(embedding) AS vectors, sum(n_chars)::BIGINT AS n_chars, "
        "round(sum(embedding[1]::DOUBLE), 4) AS first FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang, source",
    ),
    "plan_apply_drops": (plan_apply_drops, "SELECT doc_id, source, 'full' AS split FROM documents"),
    "plan_apply_custom": (
        plan_apply_custom,
        "SELECT upper(lang) AS lang, n_chars * 2 AS n_chars, n_chars % 2 = 0 AS even, strlen(text) AS bytes, source, 'full' AS split FROM documents",
    ),
    "plan_apply_dates": (plan_apply_dates, "SELECT o_orderkey, year(o_orderdate)::INT AS o_year, o_orderstatus, 'full' AS split FROM orders"),
    "plan_apply_renamed": (
        plan_apply_renamed,
        "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS segment_{v}" for v in SEGMENTS) + ", c_acctbal, 'full' AS split FROM customer",
    ),
    "plan_apply_ffill_dropped_ids": (_filled_events("ffill"), _filled_sql("user_id", "ts")),
    "plan_apply_bfill_split": (_filled_events("bfill"), _filled_sql("user_id, split", "ts DESC")),
    "plan_apply_resample": (
        plan_apply_resample,
        "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS ts, count(*) AS events, max(value) AS highest, 'full' AS split FROM events GROUP BY user_id, date_trunc('day', ts)",
    ),
    "plan_reload_lineitem": (
        plan_reload_lineitem,
        f"WITH t AS ({LINE_SPLIT}), m AS (SELECT avg(l_discount) AS da, stddev_samp(l_discount) AS ds, avg(l_tax) AS ta, stddev_samp(l_tax) AS ts FROM t WHERE split = 'train') "
        "SELECT year(l_shipdate) AS l_shipdate_year, count(*) AS row_count, round(avg((l_discount - da) / ds), 4) AS l_discount, round(avg((l_tax - ta) / ts), 4) AS l_tax, "
        "count(*) FILTER (l_returnflag = 'A') AS \"l_returnflag_A\", round(sum(l_extendedprice), 2) AS price FROM t, m GROUP BY 1",
    ),
    "plan_reload_encoded": (plan_reload_encoded, RELOAD_SQL),
    "feature_report": (
        feature_report,
        "SELECT 'lang_' || lang AS feature, 'lang' AS source_column, 'one_hot' AS transform, 'int' AS data_type FROM "
        f"(SELECT DISTINCT lang FROM ({LABELLED_SPLIT}) WHERE split = 'train') "
        f"UNION ALL SELECT 'source_' || source, 'source', 'one_hot', 'int' FROM (SELECT DISTINCT source FROM ({LABELLED_SPLIT}) WHERE split = 'train') "
        "UNION ALL SELECT 'n_chars', 'n_chars', 'standard', 'double' UNION ALL SELECT 'text_tfidf', 'text', 'tfidf', 'vector'",
    ),
    "fitted_facts": (
        fitted_facts,
        " UNION ALL ".join(
            f"SELECT '{c}' AS source_column, 'standard' AS strategy, '{n}' AS parameter, round({f}({c}), 4)::VARCHAR AS value FROM lineitem"
            for c in ("l_discount", "l_tax") for n, f in (("mean", "avg"), ("std", "stddev_samp"))
        )
        + "".join(f" UNION ALL SELECT DISTINCT '{c}', 'one_hot', 'category', {c} FROM lineitem" for c in ("l_returnflag", "l_linestatus"))
        + " UNION ALL SELECT 'l_shipdate', 'extract_parts', '', ''",
    ),
    "artifact_inventory": (
        artifact_inventory,
        "SELECT * FROM (VALUES ('full_processed_data', 'data', true, true), ('train_data', 'data/split=train', true, true), "
        "('feature_report', 'feature_report', true, true), ('preprocessor', 'parameters', true, true), ('metadata', 'metadata', false, true), "
        "('other', 'model.bin', true, false)) t(artifact_type, path, required, \"exists\")",
    ),
}
