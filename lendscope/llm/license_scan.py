"""License scans: a positional index of rare licence words, looked up by file.

Templates are short licence notices. Their words form a positional index (word -> template, place). How rare a licence
word is, is counted over all files (inverse document frequency). A file looks up the rarest licence words it holds: for
each template the postings of its ``ANCHORS`` rarest words are intersected by relative position, which gives the offsets
at which the template may begin; an offset is confirmed when every mandatory key phrase of the template stands there.

The index is fixed by the templates (a few hundred words), so a file is judged row by row: nothing is shuffled but one
count per licence word and task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a template that a file looks up (its rarest ones that the file holds).
ANCHORS = 3
#: Words that a notice may have more or less than its template between two matched words.
SLACK = 3

#: Label, notice, mandatory key phrases.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", "licensed under the MIT license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "copy of this software")),
    ("apache-2.0", "licensed under the Apache license version 2.0", ("apache license", "version 2 0")),
    ("gpl-2.0", "licensed under the GNU general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU general public license version 3", ("gnu general public license", "version 3")),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the GNU general public license",
     ("free software", "gnu general public license")),
    ("lgpl", "under the terms of the GNU lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU affero general public license", ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the Mozilla public license version 2.0", ("mozilla public license", "2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee is hereby granted")),
    ("cc-by-nc", "licensed under CC BY NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "licensed under CC BY SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "licensed under CC BY ND 4.0", ("cc by nd",)),
    ("cc0", "released into the public domain under CC0 1.0", ("cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)

#: Phrases that always count, and their labels.
BASE: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Bytes of UTF-8: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of_file(text: str | None) -> list[bytes]:
    """Lower-cased words (maximal runs of letters, digits and non-ASCII characters) as UTF-8. NULL has none."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # place in the template, words


def template(label: str, notice: str, phrases: Sequence[str]) -> Template:
    """A template; each mandatory phrase must stand in the notice."""
    words = tuple(words_of_file(notice))
    placed = []
    for phrase in phrases:
        key = tuple(words_of_file(phrase))
        at = next((i for i in range(len(words)) if words[i:i + len(key)] == key), None)
        if not key or at is None:
            raise ValueError(f"key phrase {phrase!r} does not stand in the notice {notice!r}")
        placed.append((at, key))
    if not placed:
        raise ValueError(f"notice {notice!r} has no key phrase")
    return Template(label, words, tuple(placed))


def file_frequencies(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many rows each word of ``vocabulary`` stands, and the number of rows, over the whole table.

    A row of counts comes from each Arrow batch and is summed by Spark; the driver gets one number a word.
    """
    words = list(vocabulary)
    at = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [0] * (len(words) + 1)
            for value in batch.column(0):
                found[-1] += 1
                for w in at.keys() & set(words_of_file(value.as_py())):
                    found[at[w]] += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([found], pa.list_(pa.int64()))})

    size = len(words) + 1
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "n array<bigint>")
    total = rows.agg(F.array(*[F.sum(F.col("n")[i]) for i in range(size)]).alias("n")).first().n
    return {w: total[i] or 0 for w, i in at.items()}, total[-1] or 0


class Index:
    """Postings of the templates' words, their rarity, and the phrases that always count."""

    def __init__(self, templates: Sequence[Template], base: Sequence[tuple[str, str]], frequency: Mapping[bytes, int], n_files: int):
        self.templates = tuple(templates)
        self.base = tuple((tuple(words_of_file(p)), label) for p, label in base)
        self.idf = {w: math.log((n_files + 1) / (frequency.get(w, 0) + 1)) for t in templates for w in t.words}
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for place, w in enumerate(t.words):
                postings[w].append((k, place))
        self.postings = dict(postings)
        #: Words of each template, rarest first; ties by the word.
        self.rarest = tuple(tuple(sorted(set(t.words), key=lambda w: (-self.idf[w], w))) for t in self.templates)
        self.places = tuple({w: tuple(i for i, x in enumerate(t.words) if x == w) for w in set(t.words)} for t in self.templates)
        self.starts = frozenset(p[0] for p, _ in self.base)

    def offsets(self, k: int, held: Mapping[bytes, list[int]]) -> list[int]:
        """Offsets at which template ``k`` may begin: where its rarest words that the file holds agree within the slack.

        ``held``: the file's licence words and their places. A template whose notice has several words needs two of them.
        """
        anchors = [w for w in self.rarest[k] if w in held][:ANCHORS]
        if len(anchors) < min(2, len(self.rarest[k])):
            return []
        least: list[int] | None = None
        for w in sorted(anchors, key=lambda w: len(held[w])):
            here = sorted({at - place for at in held[w] for place in self.places[k][w]})
            least = here if least is None else _near(least, here)
            if not least:
                return []
        return least or []

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, float]], list[int], set[str]]:
        """Confirmed notices (template, offset, part of its words that stand in place), places and labels of base phrases."""
        held: dict[bytes, list[int]] = defaultdict(list)
        base_at: list[int] = []
        labels: set[str] = set()
        known, starts = self.postings.keys(), self.starts
        for i, w in enumerate(words):
            if w in known:
                held[w].append(i)
            if w in starts:
                for phrase, label in self.base:
                    if tuple(words[i:i + len(phrase)]) == phrase:
                        base_at.append(i)
                        labels.add(label)
        found = []
        for k, t in enumerate(self.templates):
            if all(w in held for _, phrase in t.phrases for w in phrase):
                for at in self.offsets(k, held):
                    if all(_stands(words, phrase, at + place) for place, phrase in t.phrases):
                        found.append((k, at, _in_place(words, t.words, at)))
        return found, base_at, labels


def _near(a: list[int], b: list[int]) -> list[int]:
    """Members of ``a`` that have a member of ``b`` within the slack; both sorted."""
    out, j = [], 0
    for x in a:
        while j < len(b) and b[j] < x - SLACK:
            j += 1
        if j < len(b) and b[j] <= x + SLACK:
            out.append(x)
    return out


def _stands(words: list[bytes], phrase: tuple[bytes, ...], place: int) -> bool:
    return any(tuple(words[i:i + len(phrase)]) == phrase for i in range(max(place - SLACK, 0), max(place + SLACK + 1, 0)))


def _in_place(words: list[bytes], wanted: tuple[bytes, ...], at: int) -> float:
    """Part of the notice's words met in order from ``at`` on, each within the slack of the one before."""
    hits, here = 0, max(at, 0)
    for w in wanted:
        window = words[here:here + 1 + SLACK]
        if w in window:
            here += window.index(w) + 1
            hits += 1
    return hits / len(wanted)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("notices", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("score", T.DoubleType())]))),
    T.StructField("score", T.DoubleType())])


def fit(docs: DataFrame, templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES,
        base: Sequence[tuple[str, str]] = BASE, text: str = "text") -> Index:
    """The index, with the rarity of its words counted over all of ``docs``. An empty table makes all words equally rare."""
    made = [template(*t) for t in templates]
    frequency, n = file_frequencies(docs, sorted({w for t in made for w in t.words}), text)
    return Index(made, base, frequency, n)


def scan(docs: DataFrame, index: Index, text: str = "text", out: str = "licences") -> DataFrame:
    """``docs`` with a struct ``out`` for each row (a column of that name is replaced).

    n_words; places of base phrases (n_base), the smallest and largest (words from 0, NULL without one), their labels;
    all labels (sorted, distinct); the confirmed notices (label, word at which the notice begins, part of its words in
    place), ordered; score: the best notice's part, 1 if only base phrases stand there, 0 with neither. NULL and empty
    texts have no words. Repeated rows and ids are judged alike, row by row; texts are scanned whole, in time and memory
    in proportion to their length.
    """
    names = [c for c in docs.columns if c.lower() != out.lower()]
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
                      ("notices", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())]))),
                      ("score", pa.float64())])

    def judge(text: str | None) -> dict:
        words = words_of_file(text)
        found, places, base_labels = index.match(words)
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": sorted(base_labels),
                "labels": sorted(base_labels | {index.templates[k].label for k, _, _ in found}),
                "notices": [{"label": index.templates[k].label, "word": max(at, 0), "score": part} for k, at, part in sorted(found, key=lambda x: (x[1], x[0]))],
                "score": max((part for _, _, part in found), default=1.0 if places else 0.0)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([judge(x.as_py()) for x in batch.column(batch.num_columns - 1)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[f"c{k}" for k in range(batch.num_columns)])

    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string"))
    given = given.toDF(*[f"c{k}" for k in range(len(names) + 1)])  # any name may stand in the table
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(f"c{len(names)}", RESULT)])
    return given.mapInArrow(run, schema).toDF(*names, out)
