"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents are put in one global order in which equal texts stand together. The capacity of a shard is the smallest
for which a greedy pass needs no more shards than asked; a group larger than the capacity has a shard to itself. The
capacity is found by binary search over exact bounds: the driver holds running sizes at a bounded number of group
ends, each greedy pass is bracketed between the ends it knows, and the stretches that leave a verdict open are looked
at again in finer cells by one aggregation, until every pass is decided.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import running_totals, stage, utf8_size
from lendscope.llm.exact_dedup import classes_of, with_class

#: Cells of one look at the group ends: bounds what reaches the driver (two numbers and a count for each).
CELLS = 16_384


@dataclass
class Ends:
    """Known group ends (running sizes), and the open stretches between neighbours that may hold more."""

    known: list[int]
    open_after: set[int] = field(default_factory=set)  # known ends after which unknown ones may follow before the next

    def after(self, at: int, capacity: int) -> tuple[int, int]:
        """Lower and upper bound of the greedy cut that follows ``at``; equal where it is known."""
        total, x = self.known[-1], at + capacity
        if x >= total:
            return total, total
        i = bisect_right(self.known, x) - 1
        low = self.known[i]
        high = x if low in self.open_after else low
        if low <= at:  # perhaps nothing fits: then the next group alone
            j = bisect_right(self.known, at)
            nxt = self.known[j]
            base = self.known[j - 1]
            return (at, max(high, nxt)) if base in self.open_after else (nxt, nxt)
        return low, high

    def cuts(self, capacity: int, shards: int, lower: bool) -> list[int]:
        """Greedy cuts from below or above, ``shards`` at most."""
        at, out = 0, []
        for _ in range(shards):
            at = self.after(at, capacity)[0 if lower else 1]
            out.append(at)
            if at >= self.known[-1]:
                break
        return out


def _look(ends: DataFrame, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Lowest end, highest end and number of ends in each cell of the half-open stretches (low, high]."""
    each = max(1, CELLS // len(stretches))
    cell = F.lit(None).cast("long")
    for k, (low, high) in enumerate(stretches):
        width = max(1, -(-(high - low) // each))
        inside = (F.col("end") > low) & (F.col("end") <= high)
        cell = F.when(inside, k * (each + 1) + F.expr(f"(end - {low} - 1) div {width}")).otherwise(cell)
    rows = (ends.withColumn("cell", cell).where("cell is not null").groupBy("cell")
            .agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect())
    return sorted((r["a"], r["b"], r["n"]) for r in rows)


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(s for s in stretches if s[0] < s[1]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> list[int]:
    """The shards' upper ends under the smallest feasible capacity; ``ends`` has the running size ``end`` of each group."""
    if total <= 0:
        return [0]
    known = Ends([0, total], {0})
    low, high = 0, total  # capacity: ``low`` is not feasible, ``high`` is
    while True:
        lo, hi = low, high
        while hi - lo > 1:  # smallest capacity that is surely feasible
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if known.cuts(mid, shards, lower=True)[-1] >= total else (mid, hi)
        high = hi
        lo, hi = low, high
        while hi - lo > 1:  # largest that surely is not
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if known.cuts(mid, shards, lower=False)[-1] < total else (lo, mid)
        low = lo
        first, last = known.cuts(low + 1, shards, lower=True), known.cuts(high, shards, lower=False)
        if low + 1 == high and first == last:
            return last
        last += [total] * (len(first) - len(last))
        first += [first[-1]] * (len(last) - len(first))
        # the open stretches that hold any bracketed cut, or the end of the group after it
        wanted: list[tuple[int, int]] = []
        for a, b in zip([0, *first], [0, *last], strict=True):
            i, j = bisect_right(known.known, a) - 1, max(bisect_left(known.known, b), 1)
            j = min(max(j, i + 1), len(known.known) - 1)
            for k in range(i, j):
                if known.known[k] in known.open_after:
                    wanted.append((max(known.known[k], a if k > i else known.known[k]), known.known[k + 1]))
        stretches = _merged(wanted)
        found = _look(ends, stretches)
        added = {e for a, b, _ in found for e in (a, b)}
        cells = {a for a, b, n in found if n > 2}
        inside = lambda e: any(a <= e < b for a, b in stretches)
        known = Ends(sorted({*known.known, *added}), {e for e in known.open_after if not inside(e)} | cells)


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus 1 (NULL text: 1). Equal texts are one group and share a shard; groups follow
    their smallest id (groups without ids first). Slots count from 0 in each shard in that order, then by id; repeated
    rows take neighbouring slots. With fewer groups than shards, later shards stay empty; an empty table gives none.
    """
    rows = with_class(df, classes_of(df, id_col, text), text, {
        "id": F.col(f"`{id_col}`"), "size": utf8_size(F.col(f"`{text}`")) + 1,
        "crc": F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))})
    rows = rows.select("lowest", "h1", "h2", F.xxhash64("sha").alias("h3"), "id", "size", "crc", F.lit(1).cast("long").alias("one"))
    order = ["lowest", "h1", "h2", "h3", "id"]
    placed = stage(running_totals(rows, order, {"reach": "size", "rank": "one"}, "shard-order"), "shard-placed")
    group = placed.groupBy("lowest", "h1", "h2", "h3").agg(F.max("reach").alias("end"))
    ends = stage(group.select("end"), "shard-ends")
    total = ends.agg(F.max("end")).first()[0] or 0
    cuts = minimax_cuts(ends, total, shards)
    number = sum(((F.col("reach") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    first = placed.groupBy(number.alias("shard")).agg(F.min("rank").alias("first_rank"))  # ``shards`` rows at most
    return (placed.withColumn("shard", number).join(F.broadcast(first), "shard")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("rank") - F.col("first_rank")).alias("slot")))
