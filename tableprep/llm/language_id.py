"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one blank, and every pair and triple of characters with a letter in it
is hashed to a bucket. Training counts buckets per language inside the tasks; the log-probability matrix, of bounded
size, is broadcast, and a task scores many texts at once by gathering its rows and summing them per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import held_out, sums_between

BUCKETS = 1 << 15
MAX_LANGUAGES = 128  # with BUCKETS, bounds the broadcast matrix to 16 MB
# The classifier is fitted on about this many texts of each language, picked by a hash of their ids.
FIT_ROWS_PER_LANGUAGE = 20_000
SMOOTHING = 0.5
UNKNOWN = "und"
PIECE_CHARS = 1 << 19
_LETTER = regex.compile(r"\p{L}")  # the same that str.isalpha takes, which numerals like ½ and ² are not
_DRAW = 1 << 30


class _Alphabet:
    """Which code points are letters, as a table built once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def letters(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the places where each text's begin."""
    lowered = ["\x00" + t.lower() + "\x00\x00" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)))])
    letter = _Alphabet.letters()[points]
    points = np.where(letter, points, np.uint32(32))
    first, second, third = points[:-2], points[1:-1], points[2:]
    mix = first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)
    triple = mix * np.uint32(0xC2B2AE3D) + third * np.uint32(0x27D4EB2F)
    pair_on, triple_on = letter[:-2] | letter[1:-1], letter[:-2] | letter[1:-1] | letter[2:]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    # Bucket 0 is for nothing: no n-gram with a letter lands there.
    hashed = np.empty((len(first), 2), np.int32)
    hashed[:, 0] = np.where(pair_on, np.maximum((mix * np.uint32(0x165667B1)) >> shift, 1), 0)
    hashed[:, 1] = np.where(triple_on, np.maximum((triple ^ (triple >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, 1), 0)
    hashed[places[1:-1] - 1] = 0  # those would reach into the next text
    return hashed, np.minimum(places, len(first))


def _portions(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


class LanguageModel:
    """A fitted classifier; `predict` adds its columns to a table."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_probability: np.ndarray):
        self.languages, self.log_prior, self.log_probability = languages, log_prior, log_probability

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posterior up to a constant, one row per text."""
        hashed, places = features(texts)
        total = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            row = self.log_probability[k]
            total[:, k] = sums_between(row[hashed[:, 0]] + row[hashed[:, 1]], places)
        return total + self.log_prior

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, certain = [], []
        for portion in _portions(texts):
            if not self.languages:
                labels += [UNKNOWN] * len(portion)
                certain += [0.0] * len(portion)
                continue
            total = self.scores(portion)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for text, k, p in zip(portion, best, share):
                known = _LETTER.search(text) is not None
                labels.append(self.languages[k] if known else UNKNOWN)
                certain.append(float(p) if known else 0.0)
        return labels, certain

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, lang_pred and score (the posterior) for every row, from its whole text alone.

        Null texts and texts without a letter are `und` with score 0. Ties go to the language first by name.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels, certain = shared.value.label(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(labels, pa.string()), pa.array(certain, pa.float64())], [id_col, "lang_pred", "score"]
                )

        rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
        return rows.mapInArrow(predicted, f"`{id_col}` long, lang_pred string, score double")

    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows whose text has a language, with all their columns; those labelled `und` go."""
        shared = docs.sparkSession.sparkContext.broadcast(self)
        place = docs.columns.index(text_col)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels, _ = shared.value.label(batch.column(place).to_pylist())
                yield batch.filter(pa.array([x != UNKNOWN for x in labels], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = FIT_ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on the rows that are not held out and have a language.

    Priors are counted over all of them; bucket counts over about `rows_per_language` rows of each language, picked
    by a hash of id. Null texts count as empty. Without such rows the model knows no language and predicts `und`.
    """
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in counted]
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS)))
    totals = np.array([r["count"] for r in counted], float)
    below = F.create_map(*[
        x for name, n in zip(languages, totals) for x in (F.lit(name), F.lit(int(_DRAW * min(1.0, rows_per_language / n))))
    ])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(_DRAW)) < below[F.col(lang_col)])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in set(names.tolist()):
                own = [texts[i] for i in np.flatnonzero(names == name)]
                total = seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                for portion in _portions(own):
                    total += np.bincount(features(portion)[0].ravel(), minlength=BUCKETS)
        for name, total in seen.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], ["lang", "bucket", "n"]
            )

    per_task = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(counts, "lang string, bucket int, n long")
    table = per_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where("bucket > 0").toPandas()
    matrix = np.zeros((len(languages), BUCKETS))
    if len(table):
        matrix[table["lang"].map({x: i for i, x in enumerate(languages)}), table["bucket"]] = table["n"]
    matrix[:, 1:] += SMOOTHING
    logs = np.zeros_like(matrix)
    logs[:, 1:] = np.log(matrix[:, 1:]) - np.log(matrix[:, 1:].sum(axis=1, keepdims=True))
    return LanguageModel(languages, np.log(totals / totals.sum()), logs)
