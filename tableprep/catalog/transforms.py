"""Registered queries: imputation, encoding, scaling, dates, text, splits, remedies, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep.catalog.common import EVENTS_GAPS, LABELLED, events_with_gaps, labelled_documents, read
from tableprep.functions.hashing import draw
from tableprep.operators import dates, embedding, encode, metrics, missing, remedies, scale, split, text
from tableprep.plans import execute
from tableprep.session import materialize

DISCOUNT_GAPS = "nullif(l_discount, 0.05)"
FLAG_GAPS = "nullif(l_returnflag, 'A')"
LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def gapped_lines(s, d):
    return read(s, d, "lineitem").selectExpr(
        *LINE_KEY.split(", "), f"{DISCOUNT_GAPS} AS l_discount", f"{FLAG_GAPS} AS l_returnflag",
        "CASE WHEN l_linenumber > 5 THEN NULL ELSE l_quantity END AS l_quantity",
    )


GAPPED_LINES = (
    f"SELECT {LINE_KEY}, {DISCOUNT_GAPS} AS l_discount, {FLAG_GAPS} AS l_returnflag, "
    "CASE WHEN l_linenumber > 5 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem"
)
GAPPED_EVENTS = f"SELECT event_id, ts, user_id, event_type, {EVENTS_GAPS} AS value FROM events"


def _impute(strategy, constants=None):
    def run(s, d):
        df = gapped_lines(s, d)
        columns = ["l_returnflag", "l_discount"] if strategy in ("mode", "constant") else ["l_discount", "l_quantity"]
        filled = missing.fit_fill(df, {c: strategy for c in columns}, constants).apply(df)
        return filled.groupBy("l_returnflag", F.round("l_discount", 6).alias("l_discount"), F.round("l_quantity", 6).alias("l_quantity")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
    return run


def _impute_sql(**fills: str) -> str:
    shown = {c: fills.get(c, c) for c in ("l_discount", "l_quantity")}
    return (
        f"WITH g AS ({GAPPED_LINES}) SELECT {fills.get('l_returnflag', 'l_returnflag')} AS l_returnflag, "
        + ", ".join(f"round({v}, 6) AS {c}" for c, v in shown.items())
        + ", count(*) AS row_count FROM g GROUP BY ALL"
    )


def _from_g(function: str, *columns: str) -> dict[str, str]:
    return {c: f"coalesce({c}, (SELECT {function.format(c)} FROM g))" for c in columns}


def _carry(direction, key=None, chunks=None, segment=missing.CHUNKS_PER_SEGMENT):
    def run(s, d):
        filled = missing.fill_in_order(
            events_with_gaps(s, d), ["value"], ["ts", "event_id"], key=key, direction=direction, chunks=chunks, segment=segment
        )
        return filled.select("event_id", "user_id", "value")
    return run


def _carry_sql(function: str, frame: str, by: str) -> str:
    return (
        f"SELECT event_id, user_id, {function}(value IGNORE NULLS) OVER ({by} ORDER BY ts, event_id ROWS BETWEEN {frame}) AS value "
        f"FROM ({GAPPED_EVENTS})"
    )


BACK, AHEAD = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"


def missing_drop_rows(s, d):
    kept = missing.drop_missing_rows(gapped_lines(s, d), ["l_discount", "l_returnflag"])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def missing_count_lines(s, d):
    return missing.missing_counts(gapped_lines(s, d), ["l_discount", "l_returnflag", "l_quantity"])


def encode_onehot(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_mktsegment")
    return encode.fit_one_hot(df, "c_mktsegment").apply(df)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def encode_onehot_unseen(s, d):
    df = read(s, d, "documents").select("doc_id", "lang")
    return encode.fit_one_hot(df.where("lang <> 'es'"), "lang").apply(df)


def encode_onehot_vector(s, d):
    from pyspark.ml.functions import vector_to_array

    df = read(s, d, "part").select("p_partkey", "p_brand")
    encoded = encode.fit_one_hot(df, "p_brand", output="vector").apply(df)
    spots = F.posexplode(vector_to_array("p_brand_vector"))
    return encoded.select("p_partkey", spots.alias("category_index", "flag")).where("flag > 0").groupBy("category_index").agg(
        F.count(F.lit(1)).alias("parts")
    ).select(F.col("category_index").cast("bigint").alias("category_index"), "parts")


def encode_clashing(s, d):
    """Two columns encoded in a table whose own columns bear the names that encoders use inside."""
    df = read(s, d, "customer").selectExpr(
        "c_custkey", "c_mktsegment AS category", "c_nationkey AS fold", "c_name AS share", "c_acctbal AS encoded", "c_mktsegment AS n"
    )
    df = encode.fit_frequency(df, "category").apply(df)
    return encode.fit_ordinal(df, "share").apply(df).withColumn("category", F.round("category", 6))


def encode_ordinal(s, d):
    df = read(s, d, "part").select("p_partkey", "p_brand")
    return encode.fit_ordinal(df, "p_brand").apply(df)


def encode_frequency(s, d):
    df = read(s, d, "part").select("p_partkey", "p_type")
    return encode.fit_frequency(df, "p_type").apply(df).withColumn("p_type", F.round("p_type", 6))


def encode_target(s, d):
    df = labelled_documents(s, d).where("quality IS NOT NULL").select("doc_id", "lang", "source", "quality")
    encoded = encode.fit_target(df, "source", "quality", fold_key=["doc_id"]).apply(df)
    return encoded.select("doc_id", "lang", F.round("source", 6).alias("encoded"))


def encode_hashing(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_name")
    return encode.hashing(["c_name"], 64, portable=True).apply(df)


def encode_hashing_fast(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_name")
    return encode.hashing(["c_name"], 64).apply(df)


def _scale(scaling, columns):
    def run(s, d):
        df = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *columns)
        scaled = scale.fit_scaling(df, columns, scaling).apply(df)
        return scaled.withColumns({c: F.round(c, 5) for c in columns})
    return run


def _scale_sql(columns, expression):
    shown = ", ".join(f"round({expression.format(c)}, 5) AS {c}" for c in columns)
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {shown} FROM lineitem"


PRICES = ["l_quantity", "l_extendedprice", "l_tax"]


def dates_parts(s, d):
    return dates.extract_parts(read(s, d, "events").select("event_id", "ts"), "ts")


def dates_cyclical(s, d):
    df = dates.cyclical(read(s, d, "events").select("event_id", "ts"), "ts")
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c != "event_id"})


def _cyclical_sql() -> str:
    parts = {"month": ("month(ts)", 12), "dayofweek": ("(dayofweek(ts) + 1)", 7), "hour": ("hour(ts)", 24)}
    shown = [
        f"round({f}(2 * pi() / {period} * {expr}), 6) AS ts_{p}_{f}"
        for p, (expr, period) in parts.items() for f in ("sin", "cos")
    ]
    return f"SELECT event_id, {', '.join(shown)} FROM events"


def dates_sort_index(s, d):
    ordered = dates.sort_index(read(s, d, "events").select("event_id", "ts"), "ts", 8)
    return ordered.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def dates_resample(s, d):
    out = dates.resample(
        read(s, d, "events"), "ts", "day",
        {"events": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4), "highest": F.max("value")}, key=["event_type"],
    )
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def dates_resample_filled(s, d):
    out = dates.resample(
        read(s, d, "events"), "ts", "hour", {"events": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)},
        key=["user_id"], fill=True,
    )
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


SHARES = split.split_shares(0.7, 0.15, 0.15)


def split_random(s, d):
    return split.random_split(read(s, d, "orders").select("o_orderkey"), ["o_orderkey"], SHARES)


def split_stratified(s, d):
    df = read(s, d, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_split(df, ["o_orderkey"], "o_orderpriority", SHARES)


def split_stratified_copies(s, d):
    """Lines of one order share a key and stay together."""
    df = read(s, d, "lineitem").select("l_orderkey", "l_returnflag")
    return split.split_counts(split.stratified_split(df, ["l_orderkey"], "l_returnflag", SHARES), ["l_returnflag"])


def split_time(s, d):
    return split.time_split(read(s, d, "events").select("event_id", "ts"), "ts", SHARES).drop("ts")


def split_predefined(s, d):
    names = {"en": "train", "de": "train", "fr": "validation", "es": "test"}
    return split.predefined_split(read(s, d, "documents").select("doc_id", "lang"), "lang", names).drop("lang")


def split_inputs(s, d):
    docs = read(s, d, "documents").select("doc_id", "text")
    bench = read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return split.split_counts(split.split_inputs({"train": docs, "test": bench}))


def _label_sql(rank: str, total: str) -> str:
    return (
        f"CASE WHEN {rank} < floor({total} * 0.7 + 0.5) THEN 'train' "
        f"WHEN {rank} < floor({total} * 0.85 + 0.5) THEN 'validation' ELSE 'test' END"
    )


def _draw_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def tfidf_documents(s, d):
    df = read(s, d, "documents").select("doc_id", "text")
    scored = text.tfidf(df, ["doc_id"], "text")
    return scored.select("doc_id", "term", "tf", F.round("tfidf", 5).alias("tfidf"))


def tfidf_train_only(s, d):
    df = read(s, d, "documents").select("doc_id", "text", "lang")
    scored = text.tfidf(df, ["doc_id"], "text", corpus=df.where("lang = 'en'"))
    return scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.round(F.sum("tfidf"), 3).alias("weight")
    )


def tfidf_vectors(s, d):
    df = read(s, d, "documents").select("doc_id", "text")
    return text.fit_tfidf_vector(df, "text").apply(df).select("doc_id", F.expr("text_tfidf").alias("features"))


def text_embedding_fitted(s, d):
    """Vectors fitted on three documents in four; of the others, how many lie nearest to the mean vector of their language."""
    df = read(s, d, "documents").select("doc_id", "text", "lang").withColumn("held_out", draw(F.col("doc_id"), 42) % 4 == 2)
    step = embedding.fit_embedding(df.where("NOT held_out"), "text")
    rows = materialize(step.apply(df), "embedded")
    means = text.vector_means(rows.where("NOT held_out"), "lang", "text_embedding").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dimension", "mean"))).alias("cells"))
    centres = [(r["label"], [c["mean"] for c in r["cells"]]) for r in means.collect()]  # one vector a language
    dots = [
        F.struct(F.aggregate(F.zip_with("text_embedding", F.array(*[F.lit(x) for x in centre]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x).alias("near"), F.lit(label).alias("label"))
        for label, centre in centres
    ]
    held_out = rows.where("held_out").withColumn("nearest", F.greatest(*dots)["label"])
    return held_out.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), (F.avg((F.col("nearest") == F.col("lang")).cast("double")) >= NEAREST_LANGUAGE).alias("near"),
        F.max(F.size("text_embedding")).alias("dimensions"),
    )


NEAREST_LANGUAGE = 0.9


def text_embedding_join(s, d):
    joined = text.join_embeddings(read(s, d, "documents").select("doc_id", "lang"), read(s, d, "embeddings"), "doc_id", "vec_id", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return joined.select("doc_id", "lang", F.size("embedding").alias("dimensions"), F.round(squares, 4).alias("squared_norm")).withColumn(
        "dimensions", F.when(F.col("squared_norm").isNotNull(), F.col("dimensions"))
    )


def text_embedding_function(s, d):
    """A small encoder over Arrow batches: shares of five letters."""
    def letters(texts):
        return texts.map(lambda t: [t.count(c) / max(len(t), 1) for c in "aeiou"])
    df = text.embed_texts(read(s, d, "documents").select("doc_id", "text"), "text", letters)
    return df.select("doc_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"share_{c}") for i, c in enumerate("aeiou")])


def embedding_means(s, d):
    return text.vector_means(read(s, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 5))


def fix_missing_target(s, d):
    kept = remedies.drop_missing_target(labelled_documents(s, d), "quality")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


def fix_class_weights(s, d):
    df = labelled_documents(s, d).where("quality IS NOT NULL").select("doc_id", "quality")
    return remedies.add_class_weights(df, "quality").withColumn("class_weight", F.round("class_weight", 6))


def _rebalance(method):
    return lambda s, d: remedies.rebalance(
        read(s, d, "labels").select("doc_id", "quality"), "quality", ["doc_id"], method=method
    )


def _rebalance_sql(goal: str, copies: str) -> str:
    return (
        f"WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), w AS (SELECT doc_id, l.quality, "
        f"(SELECT {goal}(n) FROM c)::DOUBLE / n AS share, {_draw_sql('doc_id')} / 4294967296.0::DOUBLE AS u FROM labels l JOIN c ON l.quality = c.quality) "
        f"SELECT doc_id, quality FROM (SELECT doc_id, quality, unnest(range((floor(share) + (u < share - floor(share))::INT)::BIGINT)) FROM w)"
    )


def column_actions(s, d):
    df = read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    done, _ = execute.column_actions(df, [
        {"columns": ["o_orderstatus"], "action": "drop"},
        {"columns": ["o_totalprice"], "action": "rename", "params": {"o_totalprice": "price"}},
        {"columns": ["price"], "action": "cast", "params": {"type": "bigint"}},
    ])
    return done


def cast_failures(s, d):
    df = read(s, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("level"), "o_orderstatus")
    _, failed = execute.column_actions(df, [{"columns": ["level", "o_orderstatus"], "action": "cast", "params": {"type": "int"}}])
    return failed


def predictions(s, d):
    df = labelled_documents(s, d).where("quality IS NOT NULL")
    return df.select("doc_id", "quality", "n_chars", F.expr("CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted"))


PREDICTIONS = (
    "SELECT doc_id, quality, n_chars, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted "
    f"FROM ({LABELLED}) WHERE quality IS NOT NULL"
)


def metrics_classification(s, d):
    df = metrics.classification_metrics(predictions(s, d), "quality", "predicted")
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


def metrics_binary(s, d):
    df = metrics.binary_metrics(predictions(s, d), "quality", "predicted")
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def metrics_roc_auc(s, d):
    area = metrics.roc_auc(predictions(s, d), "quality", "n_chars")
    return s.createDataFrame([(round(area, 6),)], "roc_auc double")


def metrics_regression(s, d):
    df = read(s, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("predicted"))
    out = metrics.regression_metrics(df, "l_extendedprice", "predicted")
    return out.withColumns({c: F.round(c, 4) for c in ("rmse", "mae", "r2", "mape")})


def metrics_silhouette(s, d):
    score = metrics.silhouette_score(read(s, d, "embeddings"), "embedding", "label")
    return s.createDataFrame([(round(score, 5),)], "silhouette double")


SILHOUETTE = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, sum(x) AS y FROM v GROUP BY label, d),
n AS (SELECT label, count(DISTINCT vec_id)::DOUBLE AS n, sum(x * x) AS psi FROM v GROUP BY label),
q AS (SELECT vec_id, label, sum(x * x) AS nx FROM v GROUP BY vec_id, label),
dots AS (SELECT v.vec_id, c.label AS other, sum(v.x * c.y) AS dot FROM v JOIN c ON v.d = c.d GROUP BY v.vec_id, c.label),
far AS (SELECT q.vec_id, q.label, other, n.n AS size,
  (nx + psi / n.n - 2 * dot / n.n) * CASE WHEN other = q.label AND n.n > 1 THEN n.n / (n.n - 1) ELSE 1 END AS distance
  FROM q JOIN dots ON q.vec_id = dots.vec_id JOIN n ON n.label = other),
s AS (SELECT vec_id, max(CASE WHEN other = label THEN distance END) AS a, min(CASE WHEN other <> label THEN distance END) AS b,
  max(CASE WHEN other = label THEN size END) AS size FROM far GROUP BY vec_id)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s
"""

TARGET_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, quality, {_draw_sql('doc_id')} % 5 AS fold FROM ({LABELLED}) WHERE quality IS NOT NULL),
m AS (SELECT avg(quality) AS overall FROM t),
f AS (SELECT source, fold, count(*) AS n, sum(quality) AS total FROM t GROUP BY source, fold),
h AS (SELECT source, fold, sum(n) OVER (PARTITION BY source) - n AS n, sum(total) OVER (PARTITION BY source) - total AS total FROM f)
SELECT doc_id, lang, round((total + 10 * overall) / (n + 10), 6) AS encoded FROM t JOIN h USING (source, fold), m
"""

QUERIES = {
    "impute_mean": (_impute("mean"), _impute_sql(**_from_g("avg({})", "l_discount", "l_quantity"))),
    "impute_median": (_impute("median"), _impute_sql(**_from_g("median({})", "l_discount", "l_quantity"))),
    "impute_mode": (_impute("mode"), _impute_sql(**_from_g("mode({0} ORDER BY {0})", "l_returnflag", "l_discount"))),
    "impute_constant": (
        _impute("constant", {"l_returnflag": "unknown", "l_discount": -1.0}),
        _impute_sql(l_returnflag="coalesce(l_returnflag, 'unknown')", l_discount="coalesce(l_discount, -1.0)"),
    ),
    "impute_ffill": (_carry("forward", ["user_id"]), _carry_sql("last_value", BACK, "PARTITION BY user_id")),
    "impute_bfill": (_carry("backward", ["user_id"]), _carry_sql("first_value", AHEAD, "PARTITION BY user_id")),
    "impute_ffill_chunked": (_carry("forward", ["user_id"], 12), _carry_sql("last_value", BACK, "PARTITION BY user_id")),
    "impute_bfill_chunked": (_carry("backward", ["event_type"], 12), _carry_sql("first_value", AHEAD, "PARTITION BY event_type")),
    "impute_ffill_levels": (_carry("forward", ["user_id"], 60, 4), _carry_sql("last_value", BACK, "PARTITION BY user_id")),
    "impute_bfill_levels": (_carry("backward", None, 60, 4), _carry_sql("first_value", AHEAD, "")),
    "impute_ffill_global": (_carry("forward", None, 32), _carry_sql("last_value", BACK, "")),
    "missing_drop_rows": (
        missing_drop_rows,
        f"SELECT l_returnflag, count(*) AS row_count, round(sum(l_extendedprice), 2) AS price FROM ({GAPPED_LINES}) "
        "WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY l_returnflag",
    ),
    "missing_counts": (
        missing_count_lines,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, count(*) - count({c}) AS missing_count FROM ({GAPPED_LINES})" for c in ("l_discount", "l_returnflag", "l_quantity")
        ),
    ),
    "encode_onehot": (
        encode_onehot,
        "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS c_mktsegment_{v}" for v in SEGMENTS) + " FROM customer",
    ),
    "encode_onehot_unseen": (
        encode_onehot_unseen,
        "SELECT doc_id, " + ", ".join(f"(lang = '{v}')::INT AS lang_{v}" for v in ("de", "en", "fr")) + " FROM documents",
    ),
    "encode_onehot_vector": (
        encode_onehot_vector,
        "SELECT r - 1 AS category_index, n AS parts FROM (SELECT row_number() OVER (ORDER BY p_brand) AS r, count(*) AS n FROM part GROUP BY p_brand)",
    ),
    "encode_clashing": (
        encode_clashing,
        "SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment)::DOUBLE / count(*) OVER (), 6) AS category, c_nationkey AS fold, "
        "dense_rank() OVER (ORDER BY c_name) - 1 AS share, c_acctbal AS encoded, c_mktsegment AS n FROM customer",
    ),
    "encode_ordinal": (encode_ordinal, "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part"),
    "encode_frequency": (
        encode_frequency,
        "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_type)::DOUBLE / count(*) OVER (), 6) AS p_type FROM part",
    ),
    "encode_target": (encode_target, TARGET_SQL),
    "encode_hashing": (encode_hashing, "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 64 AS c_name FROM customer"),
    "encode_hashing_fast": (encode_hashing_fast, None),
    "scale_standard": (_scale("standard", PRICES), _scale_sql(PRICES, "({0} - avg({0}) OVER ()) / stddev_samp({0}) OVER ()")),
    "scale_minmax": (_scale("minmax", PRICES), _scale_sql(PRICES, "({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ())")),
    "scale_robust": (
        _scale("robust", PRICES),
        _scale_sql(PRICES, "({0} - (SELECT median({0}) FROM lineitem)) / (SELECT quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) FROM lineitem)"),
    ),
    "scale_log": (_scale("log", PRICES), _scale_sql(PRICES, "ln(1 + {0})")),
    "dates_parts": (
        dates_parts,
        "SELECT event_id, year(ts) AS ts_year, quarter(ts) AS ts_quarter, month(ts) AS ts_month, day(ts) AS ts_day, "
        "dayofweek(ts) + 1 AS ts_dayofweek, hour(ts) AS ts_hour FROM events",
    ),
    "dates_cyclical": (dates_cyclical, _cyclical_sql()),
    "dates_sort_index": (dates_sort_index, "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events"),
    "dates_resample": (
        dates_resample,
        "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, count(*) AS events, round(sum(value), 4) AS total, max(value) AS highest "
        "FROM events GROUP BY 1, 2",
    ),
    "dates_resample_filled": (
        dates_resample_filled,
        "WITH e AS (SELECT user_id, date_trunc('hour', ts) AS h, value FROM events), g AS (SELECT user_id, "
        "unnest(generate_series(min(h)::TIMESTAMP, max(h)::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM e GROUP BY user_id), "
        "a AS (SELECT user_id, h, count(*) AS events, round(sum(value), 4) AS total FROM e GROUP BY user_id, h) "
        "SELECT user_id, strftime(g.h, '%Y-%m-%d %H') AS bucket, events, total FROM g LEFT JOIN a USING (user_id, h)",
    ),
    "split_random": (
        split_random,
        f"SELECT o_orderkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split "
        f"FROM (SELECT o_orderkey, {_draw_sql('o_orderkey')} / 4294967296.0::DOUBLE AS u FROM orders)",
    ),
    "split_stratified": (
        split_stratified,
        "SELECT o_orderkey, o_orderpriority, " + _label_sql("r", "n") + " AS split FROM (SELECT o_orderkey, o_orderpriority, "
        "rank() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey)) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)",
    ),
    "split_stratified_copies": (
        split_stratified_copies,
        "SELECT l_returnflag, " + _label_sql("r", "n") + " AS split, count(*) AS row_count FROM (SELECT l_returnflag, "
        "rank() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || l_orderkey)) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1, 2",
    ),
    "split_time": (
        split_time,
        "WITH m AS (SELECT epoch_us(ts)::DOUBLE AS us FROM events), c AS (SELECT quantile_cont(us, 0.7) AS a, quantile_cont(us, 0.85) AS b FROM m) "
        "SELECT event_id, CASE WHEN epoch_us(ts) <= a THEN 'train' WHEN epoch_us(ts) <= b THEN 'validation' ELSE 'test' END AS split FROM events, c",
    ),
    "split_predefined": (
        split_predefined,
        "SELECT doc_id, CASE lang WHEN 'fr' THEN 'validation' WHEN 'es' THEN 'test' ELSE 'train' END AS split FROM documents",
    ),
    "split_inputs": (
        split_inputs, "SELECT 'train' AS split, count(*) AS row_count FROM documents UNION ALL SELECT 'test', count(*) FROM benchmark"
    ),
    "text_embedding_fitted": (
        text_embedding_fitted,
        "SELECT lang, count(*) AS documents, true AS near, 32 AS dimensions FROM documents WHERE ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 4 = 2 GROUP BY lang",
    ),
    "tfidf_documents": (
        tfidf_documents,
        r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), "
        "t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term), f AS (SELECT term, count(*) AS df FROM t GROUP BY term) "
        "SELECT doc_id, term, tf, round(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)), 5) AS tfidf FROM t JOIN f USING (term)",
    ),
    "tfidf_train_only": (
        tfidf_train_only,
        r"WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), "
        "t AS (SELECT doc_id, lang, term, count(*) AS tf FROM w GROUP BY doc_id, lang, term), f AS (SELECT term, count(*) AS df FROM t WHERE lang = 'en' GROUP BY term) "
        "SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, round(sum(tf * ln(((SELECT count(*) FROM documents WHERE lang = 'en') + 1)::DOUBLE / (coalesce(df, 0) + 1))), 3) AS weight "
        "FROM t LEFT JOIN f USING (term) GROUP BY doc_id",
    ),
    "tfidf_vectors": (tfidf_vectors, None),
    "text_embedding_join": (
        text_embedding_join,
        "SELECT doc_id, lang, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squared_norm "
        "FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    ),
    "text_embedding_function": (
        text_embedding_function,
        "SELECT doc_id, " + ", ".join(
            f"round(((length(text) - length(replace(text, '{c}', '')))::DOUBLE / greatest(length(text), 1))::FLOAT::DOUBLE, 4) AS share_{c}" for c in "aeiou"
        ) + " FROM documents",
    ),
    "embedding_means": (
        embedding_means,
        "SELECT label, d - 1 AS dimension, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d",
    ),
    "fix_missing_target": (fix_missing_target, f"SELECT lang, count(*) AS documents FROM ({LABELLED}) WHERE quality IS NOT NULL GROUP BY lang"),
    "fix_class_weights": (
        fix_class_weights,
        f"WITH t AS (SELECT doc_id, quality FROM ({LABELLED}) WHERE quality IS NOT NULL) SELECT doc_id, quality, "
        "round((SELECT count(*) FROM t)::DOUBLE / ((SELECT count(DISTINCT quality) FROM t) * count(*) OVER (PARTITION BY quality)), 6) AS class_weight FROM t",
    ),
    "fix_rebalance_under": (_rebalance("under"), _rebalance_sql("min", "")),
    "fix_rebalance_over": (_rebalance("over"), _rebalance_sql("max", "")),
    "column_actions": (
        column_actions, "SELECT o_orderkey, o_orderpriority, trunc(o_totalprice)::BIGINT AS price FROM orders"
    ),
    "cast_failures": (
        cast_failures,
        "SELECT 'level' AS name, count(*) FILTER (try_cast(substr(o_orderpriority, 1, 1) AS INT) IS NULL) AS failed_casts FROM orders "
        "UNION ALL SELECT 'o_orderstatus', count(*) FILTER (try_cast(o_orderstatus AS INT) IS NULL) FROM orders",
    ),
    "metrics_classification": (
        metrics_classification,
        f"WITH p AS ({PREDICTIONS}), l AS (SELECT unnest([0, 1]) AS label), f AS (SELECT label, 2.0 * count(*) FILTER (quality = label AND predicted = label) / "
        "(count(*) FILTER (quality = label) + count(*) FILTER (predicted = label)) AS f1 FROM p, l GROUP BY label) "
        "SELECT (SELECT count(*) FROM p) AS row_count, (SELECT round(avg((quality = predicted)::INT), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f",
    ),
    "metrics_binary": (
        metrics_binary,
        f"SELECT *, round(true_positives / (true_positives + false_positives), 6) AS precision, round(true_positives / (true_positives + false_negatives), 6) AS recall, "
        "round(2 * true_positives / (2 * true_positives + false_positives + false_negatives), 6) AS f1 FROM (SELECT "
        "count(*) FILTER (quality = 1 AND predicted = 1) AS true_positives, count(*) FILTER (quality = 0 AND predicted = 1) AS false_positives, "
        f"count(*) FILTER (quality = 1 AND predicted = 0) AS false_negatives, count(*) FILTER (quality = 0 AND predicted = 0) AS true_negatives FROM ({PREDICTIONS}))",
    ),
    "metrics_roc_auc": (
        metrics_roc_auc,
        f"WITH p AS ({PREDICTIONS}), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rank FROM p) "
        "SELECT round((sum(rank) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) "
        "/ (count(*) FILTER (quality = 1)::DOUBLE * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r",
    ),
    "metrics_regression": (
        metrics_regression,
        "SELECT count(*) AS row_count, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(t), 4) AS r2, "
        "round(avg(abs(e / nullif(t, 0))), 4) AS mape FROM (SELECT l_extendedprice AS t, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)",
    ),
    "metrics_silhouette": (metrics_silhouette, SILHOUETTE),
}
