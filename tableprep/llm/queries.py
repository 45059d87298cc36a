"""The registered queries of these operators, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import (
    exact_dedup, filter_audit, html_wrapper, language_id, line_runs, mixing, ngram_join, preference_format, quality_outliers,
    sentencepiece_dropout, suffix_dedup, toxicity, vantage_clusters,
)
from tableprep.llm.common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode(read(spark, sf_dir, "documents"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.judge(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP3_SQL = """
WITH n AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.fit(docs).predict(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = preference_format.conversations(read(spark, sf_dir, "conversations"))
    rows = preference_format.format_pairs(preference_format.swapped_replies(talks))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rows.select(
        "conv_id", "rejected_from", "status", "n_prompt_turns", "prompt", "chosen_text", "rejected_text",
        written("chosen_mask").alias("chosen_mask"), written("rejected_mask").alias("rejected_mask"),
    )


OP5_SQL = """
WITH t AS (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
        '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN pos END) AS last, md5(conv_id::VARCHAR) AS o FROM t GROUP BY conv_id),
p AS (
    SELECT c.conv_id, c.last, c.o, coalesce(string_agg(CASE WHEN pos < last THEN shown END, '' ORDER BY pos), '') AS prompt,
        max(CASE WHEN pos = last THEN text END) AS reply,
        ('0x' || substr(o, 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM c) / 1000.0))::BIGINT AS bucket
    FROM c JOIN t USING (conv_id) GROUP BY ALL
),
r AS (
    SELECT *, count(*) OVER w AS n, coalesce(lead(conv_id) OVER o, first(conv_id) OVER w) AS other,
        coalesce(lead(reply) OVER o, first(reply) OVER w) AS wrong
    FROM p WHERE last IS NOT NULL
    WINDOW o AS (PARTITION BY bucket ORDER BY o, conv_id),
        w AS (PARTITION BY bucket ORDER BY o, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
s AS (
    SELECT *, CASE WHEN n = 1 THEN 'no_pair' WHEN reply = wrong THEN 'same' ELSE 'pair' END AS status,
        length(prompt) + length('<|im_start|>assistant') + 1 AS begin_at
    FROM r
)
SELECT conv_id, CASE WHEN n > 1 THEN other END AS rejected_from, status,
    CASE status WHEN 'pair' THEN last - 1 WHEN 'same' THEN last END AS n_prompt_turns,
    CASE WHEN status = 'pair' THEN prompt END AS prompt,
    CASE WHEN status = 'pair' THEN '<|im_start|>assistant' || chr(10) || reply || '<|im_end|>' || chr(10) END AS chosen_text,
    CASE WHEN status = 'pair' THEN '<|im_start|>assistant' || chr(10) || wrong || '<|im_end|>' || chr(10) END AS rejected_text,
    CASE WHEN status = 'pair' THEN begin_at || '-' || (begin_at + length(reply) + length('<|im_end|>')) END AS chosen_mask,
    CASE WHEN status = 'pair' THEN begin_at || '-' || (begin_at + length(wrong) + length('<|im_end|>')) END AS rejected_mask
FROM s
UNION ALL
SELECT conv_id, NULL, 'no_pair', NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE last IS NULL
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("row_hash", "times")


def op8_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(read(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read(spark, sf_dir, "documents")).drop("row_hash")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return model.predict(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_report(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP11_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
),
k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
),
c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keep_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = """
WITH letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
m AS (
    SELECT t.doc_id, part,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM t
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
    SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
    FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
),
steps AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, good, toxic, n,
        contains(fails, substr(filter_order, step, 1)) AS failing,
        len([c for c in string_split(substr(filter_order, 1, step - 1), '') if c <> '' AND contains(fails, c)]) = 0 AS alive
    FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)
),
counted AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN alive AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN alive AND failing THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN NOT alive AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN alive AND failing AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN alive AND failing AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM steps GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley, f AS filter
FROM counted
"""


def op13_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_clusters.cluster(read(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int = vantage_clusters.ROUNDS) -> str:
    """The rounds written out; the products of whole numbers are exact as doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
    SELECT vec_id, any_value(v) AS v, min((vv - 2 * list_inner_product(v, c) + cc)::BIGINT * 64 + k) AS best FROM v, c{r} GROUP BY vec_id
),
m{r} AS (
    SELECT k, list(floor(total / n) ORDER BY place) AS mean
    FROM (
        SELECT best % 64 AS k, place, sum(x) AS total, count(*) AS n
        FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL
    ) GROUP BY k
),
c{r + 1} AS MATERIALIZED (
    SELECT k, c, list_inner_product(c, c) AS cc FROM (SELECT c{r}.k, coalesce(mean, c) AS c FROM c{r} LEFT JOIN m{r} USING (k))
)""")
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, v, list_inner_product(v, v) AS vv
    FROM (
        SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
        WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64
    )
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{vantage_clusters.SEED}:' || vec_id), v) - 1 AS k, v AS c, vv AS cc
    FROM v ORDER BY k LIMIT {vantage_clusters.CENTROIDS}
),{",".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, best // 64 AS distance, (sum(best // 64) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
    (sum(best // 64) OVER ())::BIGINT AS inertia, sha256(array_to_string([x::BIGINT for x in c], ',')) AS centroid_sha256
FROM (SELECT vec_id, best, best % 64 AS k FROM a{rounds}) JOIN c{rounds} USING (k)
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_quality_outliers": (op2_quality_outliers, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_preference_format": (op5_preference_format, OP5_SQL),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_mixing": (op7_mixing, None),
    "op8_html_wrapper": (op8_html_wrapper, None),
    "op9_ngram_join": (op9_ngram_join, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_line_runs": (op11_line_runs, OP11_SQL),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_vantage_clusters": (op13_vantage_clusters, _clusters_sql()),
}
