"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded first: compatibility forms, invisible marks, look-alike letters of other scripts, and digits or
signs that stand for letters. The lexicon holds word beginnings with a weight each, learned from labelled rows as log odds;
phrases that make a listed word harmless cancel the matches inside them. The sum of weights, normalised by length,
is turned into a probability by a one-dimensional logistic fit over counts in bins.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import held_out

# Look-alike letters, and digits and signs used in place of letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "circus clown", "sore loser", "white trash bag")

# The classifier is fitted on at most about this many labelled texts of each class, picked by a hash of their ids.
FIT_ROWS_PER_CLASS = 20_000
STEMS = (3, 4, 5, 6, 7, 8)
LONGEST_WORD = 24
EVIDENCE = 20.0  # nats of log likelihood ratio against chance, high enough for the many patterns that are tried
UNSEEN = 1.0
MIN_LOG_ODDS = 3.0
MAX_PATTERNS = 20_000
BINS = 64
CUT = 0.3
_DRAW = 1 << 30
_STANDS_IN = re.compile(r"[013457898@$!|](?=[^\W\d_])")
_INVISIBLE = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]")
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without invisible marks, look-alikes or letter substitutes. Accented letters stay as they are."""
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(_LOOKALIKES)
    return _STANDS_IN.sub(lambda m: SUBSTITUTES[m[0]], text)


_LOOKALIKES = str.maketrans(LOOKALIKES)


def patterns_of(word: str) -> list[str]:
    """The lexicon entries a folded word could count for: the word and its beginnings."""
    return [word[:n] for n in STEMS if n < len(word)] + [word]


class ToxicityModel:
    """Lexicon, exceptions and calibration. `measure` gives weight per root of length, `score` a probability."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...], slope: float, bias: float):
        self.lexicon, self.exceptions, self.slope, self.bias = lexicon, exceptions, slope, bias
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _matcher(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for stem, weight in self.lexicon.items():
                self._automaton.add_word(" " + stem, (len(stem) + 1, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(" " + fold(phrase) + " ", (len(fold(phrase)) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def measure(self, text: str | None) -> float:
        """Sum of the weights of matched words, the largest for each word, over the root of the number of words."""
        words = _WORDS.findall(fold(text)) if text else []
        if not words or not (self.lexicon or self.exceptions):
            return 0.0
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self._matcher().iter(" " + " ".join(words) + " "):
            begin = end - length + 1
            if weight is None:
                spared.append((begin, end))
            elif weight > found.get(begin, 0.0):
                found[begin] = weight
        total = sum(w for at, w in found.items() if not any(a <= at < b for a, b in spared))
        return total / math.sqrt(len(words))

    def score(self, measure: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * math.log1p(measure * 16)))))

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id, score (0 to 1) and predicted (1 from a score of 0.3) for every row, from its whole text alone.

        Null and empty texts get the score of a text without a match.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                model = shared.value
                values = [model.score(model.measure(t.as_py())) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(values, pa.float64()), pa.array([int(v >= CUT) for v in values], pa.int32())],
                    [id_col, "score", "predicted"],
                )

        rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
        return rows.mapInArrow(scored, f"`{id_col}` long, score double, predicted int")


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int) -> DataFrame:
    """Texts and labels of the sample. Only labels are sampled and broadcast, so texts stay where they are read."""
    own = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull())
    own = own.groupBy(F.col(id_col).cast("long").alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(int(_DRAW * min(1, rows_per_class / max(1, sizes.get(1, 0)))))).otherwise(
        F.lit(int(_DRAW * min(1, rows_per_class / max(1, sizes.get(0, 0)))))
    )
    picked = own.where(F.pmod(F.xxhash64(F.lit("toxicity"), "label_id"), F.lit(_DRAW)) < share).orderBy("label_id").limit(3 * rows_per_class)
    return docs.join(F.broadcast(picked), F.col(id_col).cast("long") == F.col("label_id")).select(
        F.col(text_col).alias("text"), "toxic", (F.pmod(F.xxhash64(F.lit("calibration"), "label_id"), F.lit(3)) == 0).alias("calibrates")
    )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows_per_class: int = FIT_ROWS_PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> ToxicityModel:
    """Learn from the labelled rows that are not held out: the lexicon from two thirds, the calibration from the rest,
    so that entries which stood in toxic texts by chance weigh as little as they should.

    A document labelled several times counts as toxic if any label says so; null labels are ignored. Without toxic
    rows the lexicon is empty and every score is the prior.
    """
    rows = _training_rows(docs, labels, id_col, text_col, label_col, rows_per_class)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORDS.findall(fold(text))) if text else set()
                seen[toxic].update({p for w in words if 3 < len(w) <= LONGEST_WORD for p in patterns_of(w)})
                n[toxic] += 1
        for toxic, counter in seen.items():
            names = list(counter)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, None], pa.string()), pa.array([toxic] * (len(names) + 1), pa.int32()), pa.array([*(counter[x] for x in names), n[toxic]], pa.int64())],
                ["pattern", "toxic", "n"],
            )

    learning, calibrating = rows.where("NOT calibrates"), rows.where("calibrates")
    table = learning.mapInArrow(counts, "pattern string, toxic int, n long").groupBy("pattern").pivot("toxic", [0, 1]).sum("n").na.fill(0)
    totals = table.where("pattern IS NULL").first()
    clean_rows, toxic_rows = (totals["0"], totals["1"]) if totals else (0, 0)
    odds = F.log((F.col("1") + 0.5) / (toxic_rows + 1)) - F.log((F.col("0") + UNSEEN) / (clean_rows + UNSEEN))
    share = toxic_rows / max(1, toxic_rows + clean_rows)
    both = F.col("0") + F.col("1")
    evidence = F.col("1") * F.log(F.greatest(F.col("1"), F.lit(1)) / (both * share + 1e-9)) + F.col("0") * F.log(
        F.greatest(F.col("0"), F.lit(1)) / (both * (1 - share) + 1e-9)
    )
    chosen = (
        table.where(F.col("pattern").isNotNull() & (F.col("1") > 0)).select("pattern", odds.alias("odds"), evidence.alias("evidence"))
        .where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("evidence") >= EVIDENCE)).orderBy(F.desc("odds"), "pattern").limit(MAX_PATTERNS)
    )
    lexicon = {r["pattern"]: float(r["odds"]) for r in chosen.collect()}
    model = ToxicityModel(lexicon, exceptions, 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[toxic, min(BINS - 1, int(math.log1p(shared.value.measure(text) * 16) * 8))] += 1
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(total[at[:, 0], at[:, 1]])], ["toxic", "bin", "n"]
        )

    bins = calibrating.mapInArrow(binned, "toxic int, bin int, n long").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect()
    counted = np.zeros((2, BINS))
    for r in bins:
        counted[r["toxic"], r["bin"]] = r["n"]
    model.slope, model.bias = _logistic(counted)
    return model


def _logistic(counted: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve through binned counts, by Newton steps with a little shrinkage."""
    x = (np.arange(BINS) + 0.5) / 8
    x[0] = 0.0
    toxic, every = counted[1], counted.sum(axis=0)
    w = np.zeros(2)
    design = np.stack([x, np.ones(BINS)], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (toxic - every * p) - 0.1 * w
        curvature = (design * (every * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w += np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return float(w[0]), float(w[1])
