"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Features of a text are hashed: its words, its word pairs (a word followed by itself is one shared feature) and the
character n-grams of its words. Each has a learned vector; a document is the mean of its features' vectors, and a
softmax over two classes gives its quality. Vectors and output are fitted together by stochastic gradient descent in
numpy on a bounded sample of labelled rows. As the output is linear in the mean, scoring needs one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import textvec as tv

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
CHARACTERS = (2, 3)
DIMENSIONS = 12
#: Labelled rows that are fitted at most.
SAMPLE_ROWS = 3000
EPOCHS = 8
RATE = 0.6
REPEAT = 0


@dataclass
class QualityModel:
    vectors: np.ndarray  # features x dimensions
    output: np.ndarray   # dimensions x 2
    bias: np.ndarray     # 2

    def per_feature(self) -> np.ndarray:
        """Each feature's share in the log-odds of label 1."""
        out = self.vectors @ self.output
        return out[:, 1] - out[:, 0]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts of a stretch, each with the text it belongs to."""
    starts, ends, doc = tv.word_bounds(data, off)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    scale = tv.odd_constants(8, 31)
    shift = np.uint64(64 - BUCKET_BITS)
    words = tv.word_hashes(data, starts, ends, lower=False)
    at, owner = [words * scale[0] >> shift], [doc]
    beside = doc[1:] == doc[:-1]
    pairs = np.where(words[1:] == words[:-1], np.uint64(REPEAT), tv.mix(words[:-1] * scale[1] + words[1:] * scale[2]) >> shift)
    at.append(pairs[beside])
    owner.append(doc[1:][beside])
    # characters: bytes of the word between two marks
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    solid = np.cumsum(inside[:-1]) > 0
    width = ends - starts + 2
    place = np.concatenate([[0], np.cumsum(width)])
    marked = np.full(place[-1], 32, dtype=np.uint64)
    body = np.ones(place[-1], dtype=bool)
    body[place[:-1]] = False
    body[place[1:] - 1] = False
    marked[body] = data[solid]
    word = np.repeat(np.arange(len(starts)), width)
    for k, n in enumerate(CHARACTERS):
        size = len(marked) - n + 1
        total = np.full(size, n, dtype=np.uint64)
        for j in range(n):
            total += marked[j:j + size] * scale[3 + j]
        own = word[:size] == word[n - 1:]
        at.append((tv.mix(total[own]) >> shift))
        owner.append(doc[word[:size][own]])
    return np.concatenate(at).astype(np.int64), np.concatenate(owner)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tv.chunks(batch.column(2)):
            at, owner = features(data, off)
            by = np.argsort(owner, kind="stable")
            at, cut = at[by], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])
            pairs = [np.unique(at[i:j], return_counts=True) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                 *(pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1))], ["label", "rank", "at", "times"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label",
        sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on ``labels`` (id, label 0 or 1) and the texts of ``docs``; at most ``sample_rows`` labels, by the id's hash.

    Labels are chosen before they meet a text, so only chosen texts are moved. Rows with NULL or another label are
    left out, and labels without a document add nothing. Labels that repeat count once; where an id repeats, the text
    with the smallest hash stands for it. Without rows every text scores one half.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)").distinct()
    chosen = marked.withColumn("rank", F.md5(F.col("id").cast("string").cast("binary"))).orderBy("rank", "label").limit(sample_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # one text for each chosen label, kept while rows are read: ``sample_rows`` rows at most, however often an id repeats
    sample = (rows.join(F.broadcast(chosen), "id").groupBy("id", "label", "rank").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
              .select("label", "rank", "text"))
    table = sample.mapInArrow(_counted, "label int, rank string, at array<int>, times array<int>").toArrow().sort_by(
        [("rank", "ascending"), ("label", "ascending")])
    random = np.random.default_rng(13)
    model = QualityModel(random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS, np.zeros((DIMENSIONS, 2)), np.zeros(2))
    marks = table["label"].to_pylist()
    found = [(a.values.to_numpy(), t.values.to_numpy(), y) for a, t, y in zip(table["at"], table["times"], marks, strict=True)]
    steps, step = max(EPOCHS * len(found), 1), 0
    for _ in range(EPOCHS):
        for d in random.permutation(len(found)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, times, y = found[d]
            share = times / max(times.sum(), 1.0)
            mean = share @ model.vectors[at]
            x = mean @ model.output + model.bias
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y] -= 1
            back = model.output @ p
            model.output -= rate * np.outer(mean, p)
            model.bias -= 0.1 * rate * p
            model.vectors[at] -= rate * share[:, None] * back[None, :] * len(at) ** 0.5
    return model


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, score (probability of label 1, 0 to 1).

    A text without words, or NULL, has the score of the bias alone. Texts are scored whole and one by one; ids may be
    NULL or repeat; other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast((model.per_feature(), float(model.bias[1] - model.bias[0])))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bias = held.value
        for batch in batches:
            for a, b, data, off in tv.chunks(batch.column(1)):
                at, owner = features(data, off)
                total = np.bincount(owner, odds[at], minlength=b - a)
                count = np.bincount(owner, minlength=b - a)
                x = total / np.maximum(count, 1) + bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500))))], ["id", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(scored, "id long, score double").withColumnRenamed("id", id_col)
