"""MinHash near-duplicate classes by a signature-coordinate inverted join.

A text's set are its five-word shingles. Texts with equal sets are folded to one class first, so copies never meet.
A class's signature has ``COORDINATES`` values, each made of ``ROWS`` minimum hashes. Classes are posted under each
(coordinate, value) of a prefix: a pair that agrees in ``MATCHES`` coordinates or more agrees in one of any
``COORDINATES - MATCHES + 1`` of them, so later coordinates need no postings. Within a posting list the collisions of
two classes are counted over their whole signatures; a pair is skipped unless this list is the first that both are
in, and retained with ``MATCHES`` collisions. Retained classes are then confirmed on their full sets.

Long lists are cut into blocks of bounded size that meet two by two in tasks of their own; a task returns who has a
partner, and after confirmation a spanning forest of links, never all pairs. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm import textvec as tv
from lendscope.llm.common import fresh, stage

COORDINATES, ROWS, MATCHES = 32, 3, 5
PREFIX = COORDINATES - MATCHES + 1
#: Low bits of a posting list's number, which name its coordinate.
COORDINATE_MASK = (1 << (COORDINATES - 1).bit_length()) - 1
#: Words of 64 bits of the filters that are broadcast (4 MB): rows whose key's bit is not set take no part in a join.
FILTER_WORDS = 1 << 18
#: Members of a posting list that one block holds.
BLOCK = 512
#: Columns of the incidence matrix that one product takes.
COLUMNS = 16_384


def signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signature of each set, one row a set; sets must not be empty."""
    scale, salt, join = tv.odd_constants(COORDINATES * ROWS, 3), tv.odd_constants(COORDINATES * ROWS, 4), tv.odd_constants(ROWS, 6)
    out = np.zeros((len(off) - 1, COORDINATES), dtype=np.uint64)
    for k in range(COORDINATES * ROWS):
        least = np.minimum.reduceat((values ^ salt[k]) * scale[k], off[:-1])
        out[:, k // ROWS] += least * join[k % ROWS]
    return tv.mix(out)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b, data, off in tv.chunks(texts):
            values, at = tv.shingles(data, off)
            count = np.diff(at)
            full = np.flatnonzero(count)
            sig = np.zeros((b - a, COORDINATES), dtype=np.uint64)
            digest = np.zeros((2, b - a), dtype=np.uint64)
            if len(full):
                # rows without shingles add no values, so offsets of the others stay in order
                edges = np.append(at[full], len(values))
                sig[full] = signatures(values, edges)
                for k, salt in enumerate(tv.odd_constants(2, 8)):
                    digest[k, full] = np.add.reduceat(tv.mix(values ^ salt), edges[:-1])
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                tv.long_lists(sig.reshape(-1), np.arange(b - a + 1) * COORDINATES)], ["id", "th", "n", "d1", "d2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in tv.chunks(batch.column(1)):
            values, at = tv.shingles(data, off)
            digest = np.zeros(b - a, dtype=np.uint64)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                digest[full] = np.add.reduceat(tv.mix(values ^ tv.odd_constants(2, 8)[0]), at[full])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(digest.view(np.int64)), tv.long_lists(values, at)], ["cid", "d1", "shingles"])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each block pair that have a partner there with ``MATCHES`` collisions, first met in this list."""
    keep: list[pa.Table] = []
    held = 0
    for group in tv.runs(batches, ["list", "i", "j"]):
        group = group.combine_chunks()
        m = group.num_rows
        if m < 2:
            continue
        sig = tv.list_values(group["sig"].chunk(0))[0].reshape(m, COORDINATES)
        coord, block = group["list"][0].as_py() & COORDINATE_MASK, group["block"].to_numpy()
        across = group["i"][0].as_py() != group["j"][0].as_py()
        mate = np.zeros(m, dtype=bool)
        for a in range(0, m, 128):
            same = sig[a:a + 128, None, :] == sig[None, :, :]
            pair = (same.sum(-1) >= MATCHES) & (same.argmax(-1) == coord)
            if across:
                pair &= block[a:a + 128, None] != block[None, :]
            pair[np.arange(len(pair)), np.arange(a, a + len(pair))] = False
            mate[a:a + 128] |= pair.any(1)
            mate |= pair.any(0)
        if mate.any():
            keep.append(group.select(["list", "i", "j", "cid", "d1"]).filter(pa.array(mate)))
            held += len(keep[-1])
        if held > 5000:
            yield from pa.concat_tables(keep).combine_chunks().to_batches()
            keep, held = [], 0
    if keep:
        yield from pa.concat_tables(keep).combine_chunks().to_batches()


def overlaps(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of a block pair (matrix)."""
    m = len(off) - 1
    if m == 2:
        both = len(np.intersect1d(values[:off[1]], values[off[1]:], assume_unique=True))
        return np.array([[off[1], both], [both, off[2] - off[1]]])
    _, which, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), np.diff(off))
    shared = times[which] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[which[shared]], owner[shared]
    out = np.zeros((m, m), dtype=np.float32)
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((m, min(COLUMNS, int(column[b - 1]) - first + 1)), dtype=np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        out += held @ held.T
    return np.rint(out).astype(np.int64)


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[tuple[int, int]] = []
        high: list[tuple[int, int]] = []
        for group in tv.runs(batches, ["list", "i", "j"]):
            group = group.combine_chunks()
            m = group.num_rows
            if m < 2:
                continue
            values, off = tv.list_values(group["shingles"].chunk(0))
            ids, digest = group["cid"].to_numpy(), group["d1"].to_numpy()
            nodes = list(zip(ids.tolist(), digest.tolist(), strict=True))
            sizes = np.diff(off)
            inter = overlaps(values, off)
            linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
            root = np.full(m, -1)
            for s in np.lexsort((digest, ids)):  # breadth first from the smallest node: a star for each component
                if root[s] >= 0:
                    continue
                root[s], edge = s, np.array([s])
                while len(edge):
                    found = np.flatnonzero(linked[edge].any(0) & (root < 0))
                    root[found] = s
                    edge = found
            out = [k for k in range(m) if nodes[root[k]] != nodes[k]]  # a class may stand in both blocks
            low += [nodes[root[k]] for k in out]
            high += [nodes[k] for k in out]
            if len(low) > 20_000:
                yield batch_of(low, high)
                low, high = [], []
        if low:
            yield batch_of(low, high)

    def batch_of(low: list[tuple[int, int]], high: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f"{side}{part}": pa.array([x[k] for x in nodes], pa.int64())
                                           for side, nodes in (("a", low), ("b", high)) for k, part in enumerate(("id", "d1"))})

    return links


def _bit(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in a filter."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))


def only_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``wanted`` (one column of keys); an exact join must follow.

    The filter has ``FILTER_WORDS`` rows at most, whatever the number of keys. When it fills up it lets more rows
    through and the join sees more of them; results do not change.
    """
    word, bit = _bit(wanted[wanted.columns[0]])
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _bit(df[key])
    return (df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
            .where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*df.columns))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b; of any type with an order): the smallest node reachable.

    Large-star, small-star rounds.
    """
    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    seen = measure(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "near-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # every edge runs from the larger id to the smaller
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.a", "e.b").where("a <> b").distinct(), "near-edges")
        before, seen = seen, measure(now)
        if seen == before:
            break
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def text_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: id, th (hash of its text), n, the digests d1, d2 of its set, and component.

    Nodes are classes of equal sets, named by their smallest id and a digest: rows that share an id but not the set are
    different nodes. component is the smallest node (cid, d1) reachable, NULL without words or id.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    described = stage(rows.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        _describe, "id long, th long, n long, d1 long, d2 long, sig array<long>"), "near-described")
    classes = stage(described.where("n > 0 and id is not null").groupBy("d1", "d2").agg(
        F.min("id").alias("cid"), F.first("sig").alias("sig")), "near-classes")
    # a list's number: hash of coordinate and value, its low bits the coordinate
    number = F.xxhash64("coord", "value").bitwiseAND(F.lit(~COORDINATE_MASK)).bitwiseOR(F.col("coord").cast("long"))
    posted = (classes.select("cid", "d1", F.posexplode(F.slice("sig", 1, PREFIX)).alias("coord", "value"))
              .select("cid", "d1", number.alias("list")))
    lists = stage(posted.groupBy("list").agg(F.count(F.lit(1)).alias("length")).where("length > 1"), "near-lists")
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    met = (only_keys(posted, "list", lists.select("list")).join(lists, "list").withColumn("blocks", blocks)
           .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "d1"))
    met = (met.join(classes.select("cid", "d1", "sig"), ["cid", "d1"])
           .repartition("list", "i", "j").sortWithinPartitions("list", "i", "j"))
    held = stage(met.mapInArrow(_partners, "list long, i int, j int, cid long, d1 long"), "near-retained")
    sets = only_keys(rows, "id", held.select("cid")).mapInArrow(
        _sets, "cid long, d1 long, shingles array<long>").dropDuplicates(["cid", "d1"])
    full = held.join(sets, ["cid", "d1"]).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    node = lambda side: F.struct(F.col(f"{side}id").alias("cid"), F.col(f"{side}d1").alias("d1")).alias(side)
    reached = components(full.mapInArrow(_confirm(percent), "aid long, ad1 long, bid long, bd1 long").select(node("a"), node("b")))
    own = F.struct("cid", "d1")
    known = (classes.select("d1", "d2", own.alias("own")).join(reached, F.col("own") == reached["id"], "left")
             .select("d1", "d2", F.coalesce("component", "own").alias("component")))
    return described.select("id", "th", "n", "d1", "d2").join(known, ["d1", "d2"], "left").select(
        "id", "th", "n", "d1", "d2", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Texts are linked with ``100 * intersection >= percent * union`` of their sets of five-word shingles (A-Z
    lower-cased; fewer words: the whole sequence as one). component_id is the smallest id reachable, and the row with
    that id is kept. Texts without words, and NULL, are linked with nothing and kept. Rows without id are linked with
    nothing, have no component and are kept. Rows that repeat an id are judged by their own texts, each for itself. Other
    columns are ignored; an empty table gives an empty result. Texts of any length are compared whole.
    """
    found = text_classes(df, id_col, text, percent)
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component.cid"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, columns unchanged: of each component the rows of its smallest node with that id.

    Rows without words or without id stay. Where an id repeats, each of its texts is judged for itself; rows equal in id
    and text stay or go together. Ties do not arise: nodes are ordered by id and digest. An empty table stays empty.
    """
    gone, hashed = fresh(df.columns, "_near_id"), fresh(df.columns, "_near_text")
    stays = (F.col("component.cid") == F.col("id")) & (F.col("component.d1") == F.col("d1"))
    dropped = (text_classes(df, id_col, text, percent).where(F.col("component").isNotNull() & ~stays)
               .select(F.col("id").alias(gone), F.col("th").alias(hashed)).distinct())
    return df.join(dropped, (F.col(f"`{id_col}`") == F.col(gone)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(hashed)), "left_anti")
