"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Every text becomes a vector of transformed statistics. For each language and source, a minimum covariance determinant
estimate finds the centre and covariance of the three quarters of the texts that lie closest together: from two
deterministic starts, concentration steps take the texts nearest by Mahalanobis distance and estimate anew, and the
start with the smaller determinant wins. Texts too far from the centre are rejected.

A step is two grouped aggregates over narrow rows. The distance that cuts off three quarters of a group is read from
counts in bins, so no group is gathered or sorted; distances come from the Cholesky factor of the covariance, written
out as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import GAP
from tableprep.session import materialize

SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

SHARE = 0.75
STEPS = 4
# For five dimensions and a share of 0.75: makes the covariance of the inner part that of the whole under normality.
CONSISTENCY = 1.41
# Spread of each dimension below which differences mean nothing; also keeps the covariance regular.
FLOORS = (0.5, 0.08, 0.25, 0.25, 0.08)
# Squared distance beyond which a text is rejected: eight spreads, as transformed statistics have long tails.
CUTOFF = 64.0
LEAST_ROWS = 50  # smaller groups are judged together
BINS, BINS_PER_FOLD = 4096, 64.0
SALTS = 32

DIMENSIONS = len(FLOORS)
VECTOR = [f"x{i}" for i in range(DIMENSIONS)]
CENTRE = [f"m{i}" for i in range(DIMENSIONS)]
FACTOR = [f"l{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]


def base_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text; null counts as empty.

    Windows of words are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.col("lang"), F.col("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("lines", lines).withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    rows = rows.select(
        id_col, "lang", "source", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW_WORDS)])
    places = F.sequence(F.lit(0), F.size("hashes") - WINDOW_WORDS)
    windows = F.when(F.size("hashes") >= WINDOW_WORDS, F.transform(places, window)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows).withColumn("several", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = F.when(F.col("several"), ordered)
    rows = rows.drop("hashes").withColumn("ordered", ordered).drop("windows")
    at = lambda i: F.get("ordered", i)["h"]
    twice = F.filter(
        F.transform("ordered", lambda x, i: F.when(x["h"].eqNullSafe(at(i + 1)) | x["h"].eqNullSafe(F.when(i > 0, at(i - 1))), x["i"])),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("starts", F.sort_array(twice)).drop("ordered")
    covered = F.aggregate(
        "starts", F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda a, s: F.struct(s.alias("last"), (a["words"] + F.least(F.lit(WINDOW_WORDS), s - a["last"])).alias("words")),
        lambda a: a["words"],
    )
    repeated = F.when(F.col("several"), covered).otherwise(F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("n_repeat_words", repeated).drop("starts", "several").withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """Logarithms of length, word length, symbols and repeated lines, and the root of the share of repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(words), F.log(chars / words), F.log1p(100.0 * F.col("n_symbols") / chars), F.log1p("n_dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _squared_distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    z: list[Column] = []
    for i in range(DIMENSIONS):
        rest = F.col(VECTOR[i]) - F.col(CENTRE[i])
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for value in z[1:]:
        total = total + value * value
    return total


def _with_factor(rows: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance in columns c00, c10, c11, ... and the log of its determinant."""
    log_det = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            rows = rows.withColumn(f"l{i}{j}", value)
        log_det = log_det + 2 * F.log(f"l{i}{i}")
    return rows.withColumn("log_det", log_det)


def _starts(vectors: DataFrame) -> DataFrame:
    """Two starts per group, both without correlations: quartiles, and mean with standard deviation."""
    quartiles = [F.percentile_approx(x, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), 10_000).alias(f"q{x}") for x in VECTOR]
    moments = [f(x).alias(f"{name}{x}") for x in VECTOR for name, f in (("a", F.avg), ("s", F.stddev_pop))]
    rows = vectors.groupBy("key").agg(*quartiles, *moments)

    def start(number: int, centre, spread) -> Column:
        fields = [F.lit(number).alias("start"), *[centre(x).alias(m) for x, m in zip(VECTOR, CENTRE)]]
        for i in range(DIMENSIONS):
            for j in range(i + 1):
                fields.append((F.greatest(spread(VECTOR[i]), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}"))
        return F.struct(*fields)

    both = F.array(
        start(0, lambda x: F.col(f"q{x}")[1].cast("double"), lambda x: (F.col(f"q{x}")[2] - F.col(f"q{x}")[0]) / 1.349),
        start(1, lambda x: F.col(f"a{x}"), lambda x: F.col(f"s{x}")),
    )
    return rows.select("key", F.inline(both))


def _per_salt(rows: DataFrame) -> DataFrame:
    """One row of each group's figures per salt: a large group must not meet them in one task."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _concentrate(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: the nearest three quarters of each group by the estimate, and the estimate from those."""
    near = vectors.join(_per_salt(estimate), ["key", "salt"]).withColumn("d2", _squared_distance())
    near = near.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.log1p("d2") * BINS_PER_FOLD)).cast("int"))
    counted = near.groupBy("key", "start", "bin").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("key", "start")
    so_far = F.sum("n").over(by_group.orderBy("bin"))
    cut = counted.select("key", "start", "bin", so_far.alias("so_far"), F.sum("n").over(by_group).alias("all"))
    cut = cut.where(F.col("so_far") >= F.ceil(F.col("all") * SHARE)).groupBy("key", "start").agg(F.min("bin").alias("cut"))
    inner = near.join(_per_salt(materialize(cut, "mcd-cuts")), ["key", "start", "salt"]).where("bin <= cut")
    off = [F.col(x) - F.col(m) for x, m in zip(VECTOR, CENTRE)]
    sums = [F.sum(off[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
    products = [F.sum(off[i] * off[j]).alias(f"p{i}{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
    total = inner.groupBy("key", "start", *CENTRE).agg(F.count("*").alias("n"), *sums, *products)
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    covariance = [
        ((F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j)) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(DIMENSIONS) for j in range(i + 1)
    ]
    total = total.select("key", "start", *[(F.col(m) + mean(i)).alias(m) for i, m in enumerate(CENTRE)], *covariance)
    return _with_factor(total).select("key", "start", *CENTRE, *FACTOR, "log_det")


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Centre and Cholesky factor per key. Ties between the starts go to the first."""
    estimate = materialize(_starts(vectors), "mcd-start")
    for _ in range(STEPS):
        estimate = materialize(_concentrate(vectors, estimate), "mcd-step")
    best = estimate.groupBy("key").agg(F.min_by(F.struct(*CENTRE, *FACTOR), F.struct("log_det", "start")).alias("best"))
    return best.select("key", "best.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The base statistics of every row, base_failed, distance (squared), and kept.

    kept is false for rows that fail the base rules, else whether the squared distance is at most `cutoff`. Estimates
    are made from rows that pass the base rules. A null language or source is one of its own. Groups of fewer than 50
    such rows are pooled; if the pool is smaller than that too, it has no estimate, its distances are null and its
    rows stay. Repeated ids are judged row by row; an empty table gives an empty result.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    named = docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})
    rows = base_statistics(named, id_col, text_col).withColumns(dict(zip(VECTOR, _vector())))
    rows = rows.withColumn("group", F.concat(known("lang"), F.lit("\x01"), known("source")))
    salt = F.pmod(F.xxhash64(id_col, "n_words", "word_chars", "n_symbols"), F.lit(SALTS))
    rows = materialize(rows.withColumn("salt", salt), "quality-rows")
    counts = rows.where("NOT base_failed").groupBy("group").count().where(F.col("count") >= LEAST_ROWS)
    counts = materialize(counts.select("group", F.col("group").alias("own")), "quality-groups")
    keyed = rows.join(_per_salt(counts), ["group", "salt"], "left").withColumn("key", F.coalesce("own", F.lit("")))
    keyed = materialize(keyed.drop("own", "group"), "quality-keyed")
    vectors = keyed.where("NOT base_failed").select("key", "salt", *VECTOR)
    alone = vectors.groupBy("key").count().where(F.col("count") >= LEAST_ROWS).select("key")
    estimates = robust_estimates(vectors).join(alone, "key", "left_semi")
    judged = keyed.join(_per_salt(materialize(estimates, "mcd-estimates")), ["key", "salt"], "left").withColumn("distance", _squared_distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "lang", "source", "distance",
    )


def _check_constant() -> float:
    """The consistency factor that CONSISTENCY rounds, for five dimensions: share over P(chi2(7) <= q), q the share's quantile."""
    quantile = 6.6257
    step, total = quantile / 20_000, 0.0
    for i in range(20_000):
        x = (i + 0.5) * step
        total += x**2.5 * math.exp(-x / 2) * step
    return SHARE / (total / (2**3.5 * math.gamma(3.5)))
