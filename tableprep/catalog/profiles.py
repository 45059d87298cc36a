"""Registered queries: profiles, top values, samples, datetime detection, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.catalog.common import (
    LABELLED,
    LABELLED_COLUMNS,
    TABLES,
    iso_sql,
    labelled_documents,
    profile_sql,
    read,
)
from tableprep.operators import heavy, profile, samples, sketches
from tableprep.operators.remedies import drop_duplicate_rows
from tableprep.session import scratch_path

SHOWN = (
    "dataset_name, name, type_class, row_count, non_null_count, missing_count, missing_rate, unique_count, unique_rate, "
    "num_min, num_max, num_mean, num_median, num_std, has_datetime_summary, datetime_min, datetime_max"
)


def shown(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 4) for c in ("num_mean", "num_median", "num_std")}
    return df.withColumns(rounded).selectExpr(*SHOWN.split(", "))


def _profile(name):
    return lambda s, d: shown(profile.column_profile(read(s, d, name), name))


def profile_of(name: str) -> str:
    return f"SELECT {SHOWN} FROM ({profile_sql(name, name, TABLES[name])})"


def profile_catalog(s, d):
    return shown(profile.catalog_profile({t: read(s, d, t) for t in TABLES}))


def profile_labelled(s, d):
    return shown(profile.column_profile(labelled_documents(s, d).select([c for c, _ in LABELLED_COLUMNS]), "labelled"))


def profile_capped(s, d):
    return shown(profile.column_profile(read(s, d, "part"), "part", max_columns=3))


def table_profiles(s, d):
    df = profile.catalog_tables({t: read(s, d, t) for t in TABLES}, max_columns=4)
    return df.select(
        "dataset_name", "row_count", "column_count", "profiled_columns",
        F.array_join("truncated_columns", ",").alias("truncated_columns"), "duplicate_row_count",
    )


def _table_profiles_sql() -> str:
    parts = []
    for t, columns in TABLES.items():
        cut = ",".join(c for c, _ in columns[4:])
        parts.append(
            f"SELECT '{t}' AS dataset_name, count(*) AS row_count, {len(columns)} AS column_count, {min(4, len(columns))} AS profiled_columns, "
            f"'{cut}' AS truncated_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_row_count FROM {t}"
        )
    return " UNION ALL ".join(parts)


def top_values_orders(s, d):
    return profile.top_values(read(s, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate"))


def _long_texts(s, d):
    """Whole documents and pages, many of which begin alike."""
    pages = read(s, d, "pages").select("html", F.lit(None).cast("string").alias("text"))
    return pages.unionByName(read(s, d, "documents").select("text", F.lit(None).cast("string").alias("html")))


LONG_TEXTS = "(SELECT html, NULL::VARCHAR AS text FROM pages UNION ALL SELECT NULL, text FROM documents)"


def top_values_documents(s, d):
    return profile.top_values(_long_texts(s, d))


def sample_values_documents(s, d):
    return profile.sample_values(_long_texts(s, d))


def sample_values_part(s, d):
    return profile.sample_values(read(s, d, "part").select("p_name", "p_brand", "p_type", "p_size"))


def heavy_values_documents(s, d):
    """The same rows as top_values, from bounded counters and one verifying count."""
    return heavy.heavy_values(_long_texts(s, d))


def heavy_values_lineitem(s, d):
    """Counters too few for the keys of lines: their loss is bounded, and what it leaves open is counted in full."""
    return heavy.heavy_values(read(s, d, "lineitem").select(*HEAVY_COLUMNS), counters=64)


HEAVY_COLUMNS = {"l_orderkey": "{}::VARCHAR", "l_returnflag": "{}", "l_linenumber": "{}::VARCHAR", "l_suppkey": "{}::VARCHAR"}


def sample_values_ordered(s, d):
    """The first texts, languages and sources along the length of the documents."""
    return samples.ordered_samples(read(s, d, "documents").select("text", "lang", "source", "doc_id", "n_chars"), "n_chars")


def sample_values_ordered_times(s, d):
    return samples.ordered_samples(read(s, d, "orders").select("o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderdate", 12)


def _ordered_sql(table: str, order: str, columns: list[str], k: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, row_number() OVER (ORDER BY o, v) AS rank, v AS value FROM "
        f"(SELECT {c}::VARCHAR AS v, min({order}) AS o FROM {table} WHERE {c} IS NOT NULL GROUP BY v ORDER BY o, v LIMIT {k})"
        for c in columns
    )


def profile_sketched(s, d):
    """A table that arrives as files of one order status each: merged sketches, with estimates held against exact counts."""
    orders = read(s, d, "orders").withColumn("o_gap", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    catalog = sketches.SketchCatalog(s, scratch_path(s, "sketches"))
    for status in ("F", "O", "P", "F"):  # one of them arrives twice
        catalog.add(orders.where(F.col("o_orderstatus") == status), f"orders-{status}")
    names = orders.columns
    exact = orders.agg(*[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(names)]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("own"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(names)
    ])))
    numbers = orders.select(*[F.col(c).cast("double").alias(c) for c in NUMBER_COLUMNS])
    # the median's rank among the rows, for numbers
    found = catalog.profile().join(F.broadcast(exact), F.col("name") == F.col("own"))
    medians = {r["name"]: r["median_estimate"] for r in found.where(F.col("name").isin(NUMBER_COLUMNS)).select("name", "median_estimate").collect()}
    ranks = numbers.agg(*[(F.count_if(F.col(c) <= medians[c]) / F.count(c)).alias(c) for c in NUMBER_COLUMNS]).first()
    near = F.coalesce(*[F.when(F.col("name") == c, F.lit(abs(ranks[c] - 0.5) < 0.02)) for c in NUMBER_COLUMNS], F.lit(True))
    return found.select(
        "name", "type_class", "row_count", "non_null_count", "missing_count", F.round("num_min", 2).alias("num_min"), F.round("num_max", 2).alias("num_max"),
        F.round("num_mean", 3).alias("num_mean"), F.round("num_std", 3).alias("num_std"),
        (F.abs(F.col("unique_estimate") - F.col("distinct")) <= F.greatest(F.lit(1), 0.07 * F.col("distinct"))).alias("distinct_near"), near.alias("median_near"),
    )


NUMBER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_gap"]


def _sketched_sql() -> str:
    source = "(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_gap FROM orders)"
    parts = []
    for c, kind in [*TABLES["orders"], ("o_gap", "float")]:
        numbers = [f"round(min({c}), 2)::DOUBLE", f"round(max({c}), 2)::DOUBLE", f"round(avg({c}), 3)", f"round(stddev_samp({c}), 3)"]
        values = ", ".join(f"{x if c in NUMBER_COLUMNS else 'NULL::DOUBLE'} AS {n}" for x, n in zip(numbers, ("num_min", "num_max", "num_mean", "num_std")))
        parts.append(
            f"SELECT '{c}' AS name, '{kind}' AS type_class, count(*) AS row_count, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, {values}, "
            f"true AS distinct_near, true AS median_near FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _ranked_sql(table: str, columns: dict[str, str], k: int, order: str) -> str:
    parts = []
    for name, text in columns.items():
        parts.append(
            f"SELECT '{name}' AS name, rank, {text.format('v')} AS value, n AS count, round_even(n::DOUBLE / total, 6) AS rate FROM ("
            f"SELECT {name} AS v, count(*) AS n, row_number() OVER (ORDER BY {order.format(name)}) AS rank, sum(count(*)) OVER () AS total "
            f"FROM {table} WHERE {name} IS NOT NULL GROUP BY {name}) WHERE rank <= {k}"
        )
    return " UNION ALL ".join(parts)


def datetime_detect(s, d):
    orders = read(s, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_text"),
        F.date_format("o_orderdate", "yyyy").alias("year_text"),
        F.expr("CASE WHEN o_custkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderpriority END").alias("half_text"),
        "o_orderpriority",
    )
    return profile.column_profile(orders, "orders", median="none").select(
        "name", "has_datetime_summary", "datetime_format", "datetime_min", "datetime_max"
    )


def _datetime_sql() -> str:
    def one(name: str, text: str, fmt: str, label: str) -> str:
        stamp = f"try_strptime({text}, '{fmt}')"
        return (
            f"SELECT '{name}' AS name, coalesce(avg(({stamp} IS NOT NULL)::INT) >= 0.8, false) AS has_datetime_summary, "
            f"CASE WHEN avg(({stamp} IS NOT NULL)::INT) >= 0.8 THEN '{label}' END AS datetime_format, "
            f"CASE WHEN avg(({stamp} IS NOT NULL)::INT) >= 0.8 THEN {iso_sql(f'min({stamp})')} END AS datetime_min, "
            f"CASE WHEN avg(({stamp} IS NOT NULL)::INT) >= 0.8 THEN {iso_sql(f'max({stamp})')} END AS datetime_max FROM orders"
        )
    day = "strftime(o_orderdate, '%Y-%m-%d')"
    return " UNION ALL ".join([
        one("day_text", day, "%Y-%m-%d", "yyyy-MM-dd"),
        one("us_text", "strftime(o_orderdate, '%m/%d/%Y')", "%m/%d/%Y", "MM/dd/yyyy"),
        one("year_text", "strftime(o_orderdate, '%Y')", "%Y", "yyyy"),
        one("half_text", f"(CASE WHEN o_custkey % 2 = 0 THEN {day} ELSE o_orderpriority END)", "%Y-%m-%d", "yyyy-MM-dd"),
        one("o_orderpriority", "o_orderpriority", "%Y-%m-%d", "yyyy-MM-dd"),
    ])


def duplicates_documents(s, d):
    docs = read(s, d, "documents").select("text", "lang", "source")
    return profile.table_profile(docs, "documents").select("dataset_name", "row_count", "duplicate_row_count")


def drop_duplicates_documents(s, d):
    kept = drop_duplicate_rows(read(s, d, "documents").select("text", "lang"))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("characters"))


def profile_report(s, d):
    customer = read(s, d, "customer")
    documents = profile.profile_document(profile.table_profile(customer, "customer"), profile.column_profile(customer, "customer"))
    return documents.select(
        "name",
        F.get_json_object("document", "$.row_count").cast("bigint").alias("row_count"),
        F.get_json_object("document", "$.unique_count").cast("bigint").alias("unique_count"),
        F.get_json_object("document", "$.duplicate_row_count").cast("bigint").alias("duplicate_row_count"),
        F.get_json_object("document", "$.type_class").alias("type_class"),
    )


def profile_quick(s, d):
    return shown(profile.quick_profile(read(s, d, "lineitem"), "lineitem"))


def nested_profile(s, d):
    df = profile.column_profile(read(s, d, "embeddings"), "embeddings")
    return df.select("name", "type_class", "row_count", "non_null_count", "unique_count")


QUERIES = {
    "profile_lineitem": (_profile("lineitem"), profile_of("lineitem")),
    "profile_orders": (_profile("orders"), profile_of("orders")),
    "profile_events": (_profile("events"), profile_of("events")),
    "profile_catalog": (profile_catalog, " UNION ALL ".join(profile_of(t) for t in TABLES)),
    "profile_labelled": (profile_labelled, f"SELECT {SHOWN} FROM ({profile_sql(f'({LABELLED})', 'labelled', LABELLED_COLUMNS)})"),
    "profile_capped": (profile_capped, f"SELECT {SHOWN} FROM ({profile_sql('part', 'part', TABLES['part'][:3])})"),
    "table_profiles": (table_profiles, _table_profiles_sql()),
    "top_values_orders": (
        top_values_orders,
        _ranked_sql("orders", {
            "o_orderstatus": "{}", "o_orderpriority": "{}", "o_custkey": "{}::VARCHAR", "o_orderdate": iso_sql("v"),
        }, 10, "count(*) DESC, {0}"),
    ),
    "top_values_documents": (top_values_documents, _ranked_sql(LONG_TEXTS, {"html": "{}", "text": "{}"}, 10, "count(*) DESC, {0}")),
    "heavy_values_documents": (heavy_values_documents, _ranked_sql(LONG_TEXTS, {"html": "{}", "text": "{}"}, 10, "count(*) DESC, {0}")),
    "heavy_values_lineitem": (heavy_values_lineitem, _ranked_sql("lineitem", HEAVY_COLUMNS, 10, "count(*) DESC, {0}")),
    "sample_values_ordered": (sample_values_ordered, _ordered_sql("documents", "n_chars", ["text", "lang", "source", "doc_id"], 5)),
    "sample_values_ordered_times": (sample_values_ordered_times, _ordered_sql("orders", "o_orderdate", ["o_custkey", "o_orderstatus", "o_orderpriority"], 12)),
    "profile_sketched": (profile_sketched, _sketched_sql()),
    "sample_values_documents": (sample_values_documents, _ranked_sql(LONG_TEXTS, {"html": "{}", "text": "{}"}, 5, "{0}")),
    "sample_values_part": (
        sample_values_part,
        _ranked_sql("part", {"p_name": "{}", "p_brand": "{}", "p_type": "{}", "p_size": "{}::VARCHAR"}, 5, "{0}"),
    ),
    "datetime_detect": (datetime_detect, _datetime_sql()),
    "duplicates_documents": (
        duplicates_documents,
        "SELECT 'documents' AS dataset_name, count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicate_row_count FROM documents",
    ),
    "drop_duplicates_documents": (
        drop_duplicates_documents,
        "SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS characters FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY lang",
    ),
    "profile_report": (
        profile_report,
        "SELECT name, row_count, unique_count, (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_row_count, type_class "
        f"FROM ({profile_sql('customer', 'customer', TABLES['customer'])})",
    ),
    "profile_quick": (profile_quick, None),
    "nested_profile": (
        nested_profile,
        "SELECT 'vec_id' AS name, 'integer' AS type_class, count(*) AS row_count, count(vec_id) AS non_null_count, count(DISTINCT vec_id) AS unique_count FROM embeddings "
        "UNION ALL SELECT 'embedding', 'object', count(*), count(embedding), count(DISTINCT embedding) FROM embeddings "
        "UNION ALL SELECT 'label', 'integer', count(*), count(label), count(DISTINCT label) FROM embeddings",
    ),
}
