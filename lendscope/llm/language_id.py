"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (lower-cased, everything else is a gap) fall into ``BUCKETS`` hash buckets. Document
frequencies are counted over all training rows on the executors. Weights are fitted with follow-the-regularised-leader
and elastic-net penalties on a bounded sample of those rows, then one temperature is calibrated on the part of the
sample that took no part in the fit. The model is ``BUCKETS`` x languages at most, and texts are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm import textvec as tv
from lendscope.llm.common import stage

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Rows of the fitting sample in all, shared among the languages.
SAMPLE_ROWS = 4000
#: Languages that a model can tell apart; the sample has at least four rows of each.
MOST_LANGUAGES = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=1)
def _constants() -> np.ndarray:
    return tv.odd_constants(4, 21)


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text; none without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points], points, 32)
    gap = points == 32
    points = points[~(gap & np.append(True, gap[:-1]))] if len(points) else points  # one space for each gap
    points = np.append(np.uint32(32), points).astype(np.uint64)
    found = []
    scale = _constants()
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        total = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            total += points[k:k + size] * scale[k]
        total *= scale[3]
        keep = slice(None) if n > 1 else points != 32
        found.append((total >> np.uint64(64 - BUCKET_BITS))[keep])
    return np.concatenate(found).astype(np.int64) if len(points) > 2 else np.zeros(0, dtype=np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = grams(text or "")
    if not len(found):
        return found, found
    times = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(times)
    return at, times[at]


def tfidf(at: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(times)) * idf[at]
    return value / max(np.sqrt(value @ value), 1e-12)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(BUCKETS + 1, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen[counted(text.as_py())[0]] += 1
            docs += 1
    seen[BUCKETS] = docs
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [counted(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))],
            ["lang", "at", "times"])


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader: per-coordinate steps, L1 keeps weights at zero, L2 shrinks them."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def leader(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    random = np.random.default_rng(5)
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            at, value, label = rows[r]
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = leader(at)
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = leader(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log-loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _sampled(rows: DataFrame, sizes: dict[str, int], each: int) -> DataFrame:
    """(lang, text) of the ``each`` rows of every language with the smallest hashes of key and text; equal rows count once.

    Hashes below a language's cut, about twice as many as wanted, are ranked without their texts; where that was too few,
    the cut is raised. Texts are then picked by the chosen hashes, at most ``each`` a language.
    """
    spark = rows.sparkSession
    hashed = rows.select("lang", "text", F.md5(F.concat_ws("\0", F.md5(F.col("text").cast("binary")), "key").cast("binary")).alias("h"))
    share = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / 2.0**52
    cuts = {x: min(1.0, (2 * each + 64) / n) for x, n in sizes.items()}
    while True:
        table = spark.createDataFrame(sorted(cuts.items()), "lang string, cut double")
        low = hashed.select("lang", "h", share.alias("share")).join(F.broadcast(table), "lang").where("share < cut").select("lang", "h").distinct()
        first = Window.partitionBy("lang").orderBy("h")  # about 2 * ``each`` hashes a language
        chosen = stage(low.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "h"), "language-sample")
        found = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}
        few = [x for x in cuts if found.get(x, 0) < each and cuts[x] < 1.0]
        if not few:
            return hashed.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
        cuts |= {x: min(1.0, 8 * cuts[x]) for x in few}


def fit(train: DataFrame, key: Column, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the rows of ``train`` that have text and language; ``key`` orders rows for the sample.

    Statistics cover all these rows; at most ``sample_rows`` of them, the same number for each language, are fitted (all of
    a language that has fewer). More than ``MOST_LANGUAGES`` languages raise.
    Without any such row the model knows no language.
    """
    rows = train.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), key.cast("string").alias("key")).where(
        "text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"column {lang!r} has more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    seen = np.zeros(BUCKETS + 1)
    for r in rows.select("text").mapInArrow(_document_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        seen[r[0]] = r[1]
    idf = np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1
    sample = _sampled(rows, sizes, max(sample_rows // len(languages), 1))
    data = sample.mapInArrow(_features, "lang string, at array<long>, times array<long>").collect()
    data.sort(key=lambda r: (r["lang"], list(r["at"]), list(r["times"])))
    number = {x: i for i, x in enumerate(languages)}
    ready = [(at := np.array(r["at"], dtype=np.int64), tfidf(at, np.array(r["times"], dtype=np.int64), idf) if len(at) else np.zeros(0), number[r["lang"]]) for r in data]
    random = np.random.default_rng(9).permutation(len(ready))
    aside, used = random[: len(ready) // 5], random[len(ready) // 5:]
    weights, bias = _ftrl([ready[i] for i in used], len(languages), EPOCHS)
    model = LanguageModel(languages, idf, weights, bias)
    logits = np.array([model.logits(ready[i][0], ready[i][1]) for i in aside]).reshape(len(aside), len(languages))
    model.temperature = _calibrated(logits, np.array([ready[i][2] for i in aside], dtype=np.int64))
    return model


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (calibrated probability of lang_pred).

    NULL texts, texts without a letter, and every text under a model without languages are ``und`` with score 0.
    Texts are scored whole and one by one; ids may be NULL or repeat; other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast(
        LanguageModel(model.languages, model.idf, model.weights.astype(np.float64), model.bias, model.temperature))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1):
                at, times = counted(t.as_py())
                if not len(at) or not m.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(m.logits(at, tfidf(at, times, m.idf)) / m.temperature)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "lang_pred", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(scored, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
