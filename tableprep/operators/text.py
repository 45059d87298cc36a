"""Text features: TF-IDF in long form or as hashed vectors, and embeddings by join or user function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import quoted
from tableprep.functions.joins import left_join, lookup
from tableprep.operators.fitted import Fitted, StepData, Transform, fact, make, step_kind
from tableprep.operators.fitting import Answers, Fit, fit_together

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
HASHED_FEATURES = 1 << 16


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, tf). Texts are dealt by key, so that their terms, which take several times their room, are counted in place."""
    dealt = df.select(*[quoted(k) for k in key], quoted(text)).repartition(*[quoted(k) for k in key])
    exploded = dealt.select(*[quoted(k) for k in key], F.explode(tokens(quoted(text))).alias("term"))
    return exploded.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) over the N documents of `df`."""
    total = df.count()
    distinct = df.select(F.explode(F.array_distinct(tokens(quoted(text)))).alias("term"))
    counted = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("idf", F.log(F.lit(float(total + 1)) / (F.col("df") + F.lit(1.0))))


def tfidf(df: DataFrame, key: list[str], text: str, *, corpus: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, idf, tfidf). Frequencies come from `corpus`, by default `df` itself.

    Terms of the corpus that fill a third of it are looked up by broadcast, see `lookup`.
    Terms the corpus lacks get the idf of df = 0.
    """
    corpus = df if corpus is None else corpus
    frequencies = document_frequencies(corpus, key, text)
    unseen = F.log(F.lit(float(corpus.count() + 1)))
    joined = lookup(term_counts(df, key, text), frequencies, ["term"], weight="df")
    idf = F.coalesce("idf", unseen)
    return joined.select(*key, "term", "tf", idf.alias("idf"), (F.col("tf") * idf).alias("tfidf"))


def tfidf_fit(column: str, *, features: int = HASHED_FEATURES) -> Fit:
    """One sparse vector column of fixed width, for tables that go on to training."""
    words, counts, out = f"{column}__words", f"{column}__tf", f"{column}_tfidf"
    split = RegexTokenizer(inputCol=column, outputCol=words, pattern=TOKEN_PATTERN, gaps=False)
    hashed = HashingTF(inputCol=words, outputCol=counts, numFeatures=features)

    def fit(df: DataFrame) -> PipelineModel:
        return Pipeline(stages=[split, hashed, IDF(inputCol=counts, outputCol=out)]).fit(_texts(df, column).select(quoted(column)))

    def build(found: Answers) -> Fitted:
        params = {"column": column, "helpers": [words, counts]}
        return make("tfidf", params, facts=[fact(column, "tfidf", "features", features)], outputs={column: [out]}, models={"tfidf": found.alone})

    return Fit([column], [column], build, alone=fit)


def _texts(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.coalesce(quoted(column), F.lit("")))


@step_kind("tfidf")
def _vectors(data: StepData) -> Transform:
    column = data.params["column"]
    return lambda rows: data.models["tfidf"].transform(_texts(rows, column)).drop(*data.params["helpers"], column)


def fit_tfidf_vector(df: DataFrame, column: str, *, features: int = HASHED_FEATURES) -> Fitted:
    return fit_together(df, [tfidf_fit(column, features=features)])[0]


def join_embeddings(df: DataFrame, vectors: DataFrame, key: str, vector_key: str, vector: str) -> DataFrame:
    """Attach the vectors of another table by key; rows without one keep a null vector.

    A key that has several vectors gets one of them, the least, so no row is repeated.
    """
    side = vectors.groupBy(quoted(vector_key).alias(key)).agg(F.min(quoted(vector)).alias("embedding"))
    return left_join(df, side, [key])


def embed_texts(
    df: DataFrame, column: str, encode: Callable[[pd.Series], pd.Series], *, out: str = "embedding"
) -> DataFrame:
    """A user's encoder over Arrow batches: texts in, a list of floats per text out."""
    schema = df.select("*", F.array(F.lit(0.0).cast("float")).alias(out)).schema

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: encode(frame[column])})

    return df.mapInPandas(batches, schema)


def vector_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dimension, mean): the mean vector per label, combined per task before the shuffle."""
    cells = df.select(quoted(label).alias("label"), F.posexplode(quoted(vector)).alias("dimension", "x"))
    return cells.groupBy("label", "dimension").agg(F.avg(F.col("x").cast("double")).alias("mean"))
