"""Phrase collocations from a weighted de Bruijn graph of words.

The text of a language is cut into pieces, and every word of a piece begins one gram of up to ``LONGEST`` words. A gram of
full length is an edge between two overlapping nodes, its first and its last ``LONGEST - 1`` words; the shorter grams at
the end of a piece are the corrections for the nodes where a piece ends. Only these grams are shuffled, once, as summed
weights. How often a shorter phrase occurs is not counted again: it is the flow out of its node, the weights of all edges
that begin with it, plus the piece ends that do.

Edges of at least the wanted weight make a far smaller graph. Its unary paths (chains of nodes with one edge in and one
out) are compacted by pointer doubling: repeated passages appear as one path each, and what contains a phrase is read off
the path and off the nodes between paths.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import stage

#: Words of the longest candidate.
LONGEST = 4
#: Least count of a candidate, candidates a language returns, scale of the score, and the share (of 5: 4, that is
#: 80 %) of a candidate's places at which a longer one drops it.
MIN_COUNT = 30
TOP = 2_000
SCALE = 2_000_000
#: Bytes of text whose grams a task sums at once, and grams of them (a long text is worked on in runs). Bounds memory only.
CHUNK_BYTES = 3_000_000
CHUNK_GRAMS = 500_000
#: Pairs of first words are told apart by this many slots when shares are estimated; a slot above 1 / HOT_SHARE of the sampled
#: grams is hot, and its grams are dealt by all their words. At most HOT_SHARE slots can be hot.
SLOTS = 1 << 16
HOT_SHARE = 256
#: Part of the rows that is sampled for hot slots. The sample decides only where rows are sent.
SAMPLE = 0.05

#: Between the words of a gram: below every byte of a word, so that grams with the same first words sort together.
GAP = "\x01"
_GAP = GAP.encode()
#: Bytes of words that are not above the gap are escaped by two, in the same order.
_ESCAPED = {bytes([b]): bytes([2, b + 2]) for b in range(3)}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_LOW, _PAIRS = re.compile(rb"[\x00-\x02]"), re.compile(rb"\x02[\x02-\x04]")

#: UTF-8 bytes: A-Z to a-z, piece ends to line feeds, tabs to spaces.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _grams(texts: list[str]) -> Iterator[pa.Array]:
    """The grams that the words of ``texts`` begin, as binary arrays of at most ``CHUNK_GRAMS``, words joined by the gap.

    A gram is a slice of the joined text: from the start of its first word to the end of the last one that is no further
    than ``LONGEST`` words and still in the piece.
    """
    data = b"\n".join(t.encode() for t in texts).translate(_TABLE)
    if _LOW.search(data):
        data = _LOW.sub(lambda m: _ESCAPED[m[0]], data)
    a = np.frombuffer(data, np.uint8)
    between = (a == 32) | (a == 10)
    starts = np.flatnonzero(~between & np.concatenate([[True], between[:-1]]))
    ends = np.flatnonzero(~between & np.concatenate([between[1:], [True]])) + 1
    if not len(starts):
        return
    piece = np.cumsum(a == 10)[starts]
    inside = piece[1:] == piece[:-1]
    if (starts[1:] - ends[:-1])[inside].max(initial=1) > 1:  # several blanks in a row: only the first stays
        keep = ~between | np.concatenate([[False], ~between[:-1]])
        at = np.cumsum(keep) - 1
        a, starts, ends = a[keep], at[starts], at[ends - 1] + 1
    a = np.where(a == 32, np.uint8(ord(GAP)), a)
    bounds = np.append(np.flatnonzero(~inside), len(starts) - 1)  # the last word of each piece
    last = np.repeat(bounds, np.diff(bounds, prepend=-1))
    ends = ends[np.minimum(np.arange(len(starts)) + LONGEST - 1, last)]
    for i in range(0, len(starts), CHUNK_GRAMS):
        yield _slices(a, starts[i:i + CHUNK_GRAMS], ends[i:i + CHUNK_GRAMS])


def _slices(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of a buffer as one binary array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(a[at])])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, gram, weight): weights summed over many texts, in the order of the grams."""
    held: dict[str, list[str]] = defaultdict(list)
    size: Counter[str] = Counter()

    def emit(lang: str) -> Iterator[pa.RecordBatch]:
        for grams in _grams(held.pop(lang, [])):
            counted = grams.value_counts()
            order = pc.sort_indices(counted.field(0))
            grams, weights = counted.field(0).take(order), counted.field(1).take(order)
            for i in range(0, len(grams), 50_000):
                part = grams[i:i + 50_000].cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, weights[i:i + 50_000]], names=["lang", "gram", "weight"])
        size.pop(lang, None)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text:
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= CHUNK_BYTES:
                    yield from emit(lang)
        if size.total() >= 8 * CHUNK_BYTES:  # many languages, little of each
            for lang in list(held):
                yield from emit(lang)
    for lang in list(held):
        yield from emit(lang)


def _pair(gram: Column) -> Column:
    """The first two words of a gram (all of a shorter one)."""
    return F.substring_index(gram, GAP, 2)


def _slot(lang: Column, gram: Column) -> Column:
    return F.pmod(F.xxhash64(lang, _pair(gram)), F.lit(SLOTS))


def edge_weights(docs: DataFrame) -> DataFrame:
    """The weight of each gram as partial sums (lang, gram, weight); ``docs`` has lang and text. A NULL lang is 'und'."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_summed, "lang string, gram string, weight bigint")


def hot_slots(docs: DataFrame) -> list[int]:
    """Slots of first words that hold more than 1 / ``HOT_SHARE`` of a sample's grams; at most ``HOT_SHARE`` of them."""
    slots = stage(edge_weights(docs.sample(SAMPLE, 7)).groupBy(_slot(F.col("lang"), F.col("gram")).alias("slot"))
                  .agg(F.count(F.lit(1)).alias("n")), "gram-slots")
    total = slots.agg(F.sum("n")).first()[0] or 0
    return [r.slot for r in slots.where(F.col("n") * HOT_SHARE > total).collect()] if total else []


class _Flow:
    """Sums of sorted grams of one language by their first 1 to ``LONGEST`` words.

    What begins with the same words stands together, so beside the batch at hand only the sums of the last gram's own
    beginnings are held. Sums of one word, and all but the longest of hot slots, are partial: other tasks have further edges
    out of these nodes. Complete sums below ``least`` are left out.
    """

    def __init__(self, lang: str, least: int):
        self.lang, self.least = lang, least
        self.last, self.hot, self.sums = b"", False, [0] * LONGEST

    def add(self, grams: pa.Array, weights: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums that are complete once these grams are added."""
        given = [pa.array([self.last], pa.binary()), grams.cast(pa.binary())] if self.last else [grams.cast(pa.binary())]
        rows = pa.concat_arrays(given)
        if self.last:
            weights, hot = np.append(0, weights), np.append(self.hot, hot)
        n = len(rows)
        offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset:rows.offset + n + 1].astype(np.int64)
        data = np.frombuffer(rows.buffers()[2], np.uint8) if rows.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        # Length of what each row has in common with the one before: its first byte that differs, or that the other lacks.
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(data)) - offsets[row]
        before = np.append(0, sizes[:-1])
        other = np.maximum(np.arange(len(data)) - before[row], 0)
        differs = np.flatnonzero((place >= before[row]) | (data != data[other]))
        first = np.searchsorted(differs, offsets[:-1])
        common = np.append(differs, len(data))[first] - offsets[:-1]
        common = np.minimum(common, sizes)
        common[0] = 0
        gaps = np.flatnonzero(data == ord(GAP))
        gap_row = row[gaps]
        begin = np.searchsorted(gap_row, np.arange(n))
        words = np.searchsorted(gap_row, np.arange(n), side="right") - begin + 1
        known = np.append(gaps, 0)
        for k in range(LONGEST):
            has = words > k
            # Where the first k + 1 words end, from the start of the row.
            to = np.where(words > k + 1, known[np.minimum(begin + k, len(gaps))] - offsets[:-1], sizes)
            same = has & np.append(False, has[:-1]) & (common >= to) & (to == np.append(-1, to[:-1]))
            starts = np.flatnonzero(has & ~same)
            if not len(starts):
                self.sums[k] = 0
                continue
            totals = np.add.reduceat(np.where(has, weights, 0), starts)
            if self.last and has[0]:
                totals[0] += self.sums[k]
            goes_on = has[-1]  # the last sum may grow with the next grams
            self.sums[k] = int(totals[-1]) if goes_on else 0
            closed = len(starts) - int(goes_on)
            wanted = self._wanted(k, totals[:closed], hot[starts[:closed]])
            yield from self._out(k, data, offsets[starts[:closed]][wanted], (offsets[:-1] + to)[starts[:closed]][wanted], totals[:closed][wanted])
        self.last, self.hot = data[offsets[-2]:].tobytes(), bool(hot[-1])

    def _wanted(self, k: int, totals: np.ndarray, hot: np.ndarray) -> np.ndarray:
        return np.full(len(totals), True) if k == 0 else (totals >= self.least) | (hot if k < LONGEST - 1 else False)

    def _out(self, k: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(totals):
            phrases = _slices(np.where(data == ord(GAP), np.uint8(32), data), starts, ends)
            if (data == 2).any():
                phrases = pa.array([_PAIRS.sub(lambda m: _PLAIN[m[0]], x) for x in phrases.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * len(totals)), phrases.cast(pa.string()), pa.array(np.full(len(totals), k + 1, np.int32)), pa.array(totals)],
                names=["lang", "phrase", "n_words", "f"])

    def close(self) -> Iterator[pa.RecordBatch]:
        """The sums of the last gram's own beginnings."""
        words = self.last.split(_GAP) if self.last else []
        data = np.frombuffer(self.last, np.uint8)
        for k in range(len(words)):
            total = np.array([self.sums[k]])
            if self._wanted(k, total, np.array([self.hot]))[0]:
                yield from self._out(k, data, np.array([0]), np.array([len(_GAP.join(words[:k + 1]))]), total)


def _flows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, gram, weight, hot) sorted by lang and gram to (lang, phrase, n_words, f)."""
    flow: _Flow | None = None
    for batch in batches:
        langs = batch.column(0)
        at = 0
        while at < len(langs):
            lang = langs[at].as_py()
            to = len(langs) if langs[len(langs) - 1].as_py() == lang else at + pc.index(pc.not_equal(langs[at:], lang), True).as_py()
            if flow is None or flow.lang != lang:
                if flow is not None:
                    yield from flow.close()
                flow = _Flow(lang, least)
            yield from flow.add(batch.column(1)[at:to], batch.column(2)[at:to].to_numpy(), batch.column(3)[at:to].to_numpy(zero_copy_only=False))
            at = to
    if flow is not None:
        yield from flow.close()


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Phrases of 1 to ``LONGEST`` words with their counts, as far as these reach ``least``, and n, all words of the language.

    Returns lang, phrase, n_words, f, and one row a language with a NULL phrase and n_words 0, whose f is n.
    Grams are dealt by language and first two words, so that the edges out of a node of two words or more meet in one
    task; hot ones by all words, their shorter sums being added up after that.
    """
    hot = hot_slots(docs)
    weights = edge_weights(docs)
    is_hot = _slot(F.col("lang"), F.col("gram")).isin(hot) if hot else F.lit(False)
    dealt = weights.withColumn("hot", is_hot)
    dealt = dealt.repartition("lang", F.when(F.col("hot"), F.col("gram")).otherwise(_pair(F.col("gram"))))
    flows = dealt.sortWithinPartitions("lang", "gram").mapInArrow(lambda b: _flows(b, least), "lang string, phrase string, n_words int, f bigint")
    summed = stage(flows.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")), "phrase-flows")
    words = summed.where("n_words = 1").groupBy("lang").agg(F.sum("f").alias("f"))
    return summed.where(F.col("f") >= least).unionByName(words.select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("n_words"), "f"))


#: Edges of a compacted path that stand in one row.
SEGMENT = 1_000


def _first(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def _last(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", -n)


def unary_paths(edges: DataFrame) -> DataFrame:
    """Compact the unary paths of a graph of longest grams.

    ``edges``: lang, phrase (of ``LONGEST`` words), f; each once. A node (``LONGEST - 1`` words) with one edge in and one
    out joins the two. Every edge learns the first edge of its path and its place there by pointer doubling: as many
    rounds as the logarithm of the longest path. Edges of a cycle without an entry are paths of their own.
    Returns one row for each ``SEGMENT`` edges of a path: lang, path (its first edge's phrase), segment, words (array, that
    of the whole segment), weights (array, one an edge).
    """
    overlap = LONGEST - 1
    edges = edges.select("lang", "phrase", "f")
    into = edges.groupBy("lang", _last(F.col("phrase"), overlap).alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("phrase").alias("prev"))
    outof = edges.groupBy("lang", _first(F.col("phrase"), overlap).alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("phrase").alias("phrase"))
    links = into.join(outof, ["lang", "node"]).where("n_in = 1 and n_out = 1 and prev <> phrase").select("lang", "phrase", "prev")
    linked = edges.join(links, ["lang", "phrase"], "left")
    at = stage(linked.select("lang", "phrase", "f", F.coalesce("prev", "phrase").alias("head"),
                             F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("place")), "paths")
    # An edge is settled when its pointer is at a first edge, which points at itself.
    heads = at.where("place = 0").select("lang", F.col("phrase").alias("head"))
    done = at.join(heads, ["lang", "head"], "left_semi")
    open_ = at.join(heads, ["lang", "head"], "left_anti")
    settled, left = [done], open_.count()
    while left:
        reach = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        stepped = stage(at.join(reach, ["lang", "head"], "left").select(
            "lang", "phrase", "f", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "paths")
        open_ = stepped.join(heads, ["lang", "head"], "left_anti")
        now = open_.count()
        at, settled = stepped, [stepped.join(heads, ["lang", "head"], "left_semi")]
        if now == left:  # what a doubling does not settle runs in circles
            settled.append(open_.select("lang", "phrase", "f", F.col("phrase").alias("head"), F.lit(0).cast("long").alias("place")))
            break
        left = now
    placed = settled[0] if len(settled) == 1 else settled[0].unionByName(settled[1])
    segment = (F.col("place") / SEGMENT).cast("long")
    rows = (placed.groupBy("lang", F.col("head").alias("path"), segment.alias("segment"))
            .agg(F.array_sort(F.collect_list(F.struct("place", "phrase", "f"))).alias("edges")))
    words = F.concat(F.split(F.col("edges")[0].phrase, " "),
                     F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: _last(e.phrase, 1)))
    return rows.select("lang", "path", "segment", words.alias("words"), F.col("edges.f").alias("weights"))


def _containers(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """For each phrase, the largest count of the phrases one word longer that hold it (lang, phrase, longer).

    Longer ones still cannot count more. For phrases of ``LONGEST - 1`` words they are the edges at the node, read off the
    compacted paths: inside a path the two beside it meet in the row itself. For shorter phrases, the phrases themselves.
    """
    overlap = LONGEST - 1
    w = F.col("weights")
    nodes = paths.select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.struct(
        F.array_join(F.slice("words", i + 1, F.lit(overlap)), " ").alias("phrase"),
        F.greatest(F.get(w, i - 1), F.get(w, i)).alias("longer")))).alias("x")).select("lang", "x.*")
    inner = counts.where(f"n_words between 3 and {overlap}")
    parts = inner.select("lang", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring_index(phrase, ' ', 1 - n_words)"))).alias("phrase"), F.col("f").alias("longer"))
    return nodes.unionByName(parts).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def _cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate (lang, phrase, a) with the lowest-scoring cut into two parts: l, r, score."""
    cut = candidates.select("lang", "phrase", "n_words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cut = (cut.withColumn("left_part", F.expr("substring_index(phrase, ' ', k)"))
           .withColumn("right_part", F.expr("substring_index(phrase, ' ', k - n_words)")))
    known = counts.where(f"n_words between 1 and {LONGEST - 1}")
    lefts = known.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return (cut.join(lefts, ["lang", "left_part"]).join(rights, ["lang", "right_part"])
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``LONGEST`` words by score: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text, further columns are ignored. NULL texts count as empty, a NULL lang is 'und'; rows that
    repeat count each; very long texts are counted whole, in parts of bounded size; an empty table gives no rows. Ties of
    the score go to the larger count, then to the phrase in byte order.
    """
    counts = stage(phrase_counts(docs, least), "phrase-counts")
    paths = unary_paths(counts.where(F.col("n_words") == LONGEST))
    longer = _containers(paths, counts)
    candidates = counts.where(f"n_words between 2 and {LONGEST}").join(longer, ["lang", "phrase"], "left")
    kept = candidates.where("longer is null or cast(100 as decimal(20, 0)) * longer < cast(80 as decimal(20, 0)) * f")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)  # a part of the language each
    first = _cuts(kept, counts).withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
