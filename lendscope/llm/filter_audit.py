"""Filter interaction audit: what every order of a set of filters removes, step by step.

Each document fails some of the filters; its bit mask says which. Documents are counted by part and mask (at most 2^f
cells a part), and a recursive CTE walks the orders on these cells alone: a prefix of filters is extended by every
letter it does not use yet and carries the bits applied so far, and each level of the recursion emits the numbers of its
step. Documents are read once (and once more, as 16-byte digests, for the filter on copies); the walk's size depends on
the number of parts and filters, never on the number of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import let, stage, words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Failure conditions of the filters A to D over the text; E (a copy of a smaller id's text) needs the table.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
LETTERS = "ABCDE"


ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _bit(failed: Column, place: int) -> Column:
    return F.when(failed, F.lit(1 << place)).otherwise(F.lit(0))


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is bit 0). NULL counts as empty: it fails A alone."""
    text = F.coalesce(text, F.lit(""))

    def judged(words: Column) -> Column:
        n = F.size(words)
        return (_bit(n < MIN_WORDS, 0) + _bit(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n, 1))

    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return (let(words_of(text), judged) + _bit(100 * upper > MAX_UPPER_PERCENT * F.length(text), 2)
            + _bit(text.rlike(SYMBOLS), 3))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, mask, good, toxic.

    A NULL source is the part ''. A document fails E if a smaller id has its text; a NULL id is smaller than none and has
    no smaller one, equal ids are not smaller. Labels that repeat an id count once, as 1 if any row says 1. Rows without
    an id have no labels. Copies meet as digests only: of each text that more than one id has, one row with the smallest.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = stage(docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                             F.unhex(digest).alias("sha"), text_mask(F.col("text")).alias("mask")), "audit-masks")
    copied = (rows.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"))
              .where("first < last").select("sha", "first"))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    return (rows.join(copied, "sha", "left").join(marks, "id", "left")
            .select("part", (F.col("mask") + _bit(F.col("id") > F.col("first"), 4)).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def mask_cells(masks: DataFrame) -> DataFrame:
    """Documents, good and toxic ones counted by part and mask; partial sums before the shuffle, one row a cell after it."""
    return masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def order_walk(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Every prefix of every order with the numbers of its last step, by part.

    ``cells`` has part, mask, n, good, toxic. Returns part, prefix, letter, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost (longs). A part with a cell has all prefixes, zeros included; no cells give no rows. Each level
    joins the mask cells of its part: one array of at most 2^f cells a part.
    """
    spark = cells.sparkSession
    view = f"audit_cells_{uuid.uuid4().hex}"
    cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).createOrReplaceTempView(view)
    filters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))

    def total(condition: str, of: str = "n") -> str:
        return f"aggregate(filter(c.cells, x -> {condition}), 0L, (s, x) -> s + x.{of})"

    fails, earlier = "x.mask & f.bit <> 0", "x.mask & applied"
    walk = spark.sql(f"""
with recursive walk(part, prefix, letter, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) as (
  select part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L from {view}
  union all
  select walk.part, prefix || f.letter, f.letter, applied | f.bit, step + 1,
         {total("x.mask & (applied | f.bit) = 0")},
         {total(f"{fails} and {earlier} = 0")},
         {total(f"{fails} and {earlier} <> 0")},
         {total("x.mask = f.bit")},
         {total(f"{fails} and {earlier} = 0", "good")},
         {total(f"{fails} and {earlier} = 0", "toxic")}
  from walk join {view} c on c.part = walk.part
       lateral view explode(filter(array({filters}), y -> applied & y.bit = 0)) as f
  where step < {len(letters)})
select * from walk where step > 0""")
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # a guard for queries that may not end; this one ends after the last letter
    try:
        return stage(walk, "audit-walk")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
        spark.catalog.dropTempView(view)


def audit(docs: DataFrame, labels: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step: the numbers of that step, and the filter's Shapley sum.

    ``docs`` has doc_id, text, source; ``labels`` doc_id, quality, toxic; further columns are ignored. NULLs, repeated ids
    and labels: see ``document_masks``; repeated rows count each; texts of any length are judged whole. An empty table
    gives no rows. ``shapley``: what the filter removes, summed over all orders; a prefix of k letters begins (f - k)!
    orders.
    """
    f = len(letters)
    walk = order_walk(mask_cells(document_masks(docs, labels)), letters)
    weight = F.element_at(F.array(*[F.lit(factorial(f - k)) for k in range(1, f + 1)]), F.col("step"))
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    steps = walk.where(F.col("step") == f).select("part", F.col("prefix").alias("filter_order"),
                                                  F.explode(F.sequence(F.lit(1), F.lit(f))).alias("step"))
    return (steps.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
            .join(walk.drop("step"), ["part", "prefix"]).join(shapley, ["part", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
