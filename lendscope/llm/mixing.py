"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. Complete epochs take every document of it; the rest of the target is drawn
without replacement: each document has an exponential key scaled by its quality weight, documents follow their keys
within the source, and their running words are held against what is left of the target. The order is global
(source, key), so a source with a third of all rows is summed over many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import SPACES, fresh, running_totals, stage, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """Weight of a text from 0.1 to 1: the share of plain characters (no symbols or exclamation marks)."""
    t = F.coalesce(text, F.lit(""))
    dense = F.greatest(F.length(F.translate(t, SPACES, "")), F.lit(1))
    plain = F.length(F.translate(t, SPACES + "#*$%&|<>!", ""))
    return F.greatest(plain / dense, F.lit(0.1))


def uniform(seed: int, key: Column) -> Column:
    """Uniform number in (0, 1) from the seed and a key (52 bits of MD5), equal in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")) ).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, share: float = 1.5, limit: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to ``sizes`` (source, source_size): weights share ``share`` of all words, none over ``limit`` times its size.

    The excess of a source at its limit goes to the others by weight until none is above. That is one level L with
    target = min(limit * size, L * weight): sources in order of size / weight reach their limit one after another, so
    L follows from running sums. One row per source: a catalogue of sources, ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("n", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(pattern, (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    # full first: least size for its weight
    order = Window.orderBy(F.col("source_size") / F.col("w"), "n")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = ranked.select(
        "*", F.coalesce(F.sum("source_size").over(up_to), F.lit(0)).alias("s_before"),
        F.coalesce(F.sum("w").over(up_to), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(everything).alias("s_all"), F.sum("w").over(everything).alias("w_all"))
    level = (F.lit(share) * F.col("s_all") - limit * F.col("s_before")) / (F.col("w_all") - F.col("w_before"))
    # a source is open when its share, with all before it full, is within its limit; the level rises up to the first
    # open source and falls from there, so the first open one's level is the highest of theirs
    opened = sums.select("*", level.alias("level"), (level * F.col("w") <= limit * F.col("source_size")).alias("open"))
    final = opened.select("*", F.max(F.when(F.col("open"), F.col("level"))).over(everything).alias("L"))
    target = F.when(F.col("L").isNull(), limit * F.col("source_size").cast("double")).otherwise(
        F.least(limit * F.col("source_size").cast("double"), F.col("L") * F.col("w")))
    return final.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17,
        share: float = 1.5, limit: int = 2) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs (times the row is taken), taken (words), tie.

    Size is the number of words (NULL text: 0). NULL is a source of its own, last in order. A source without words
    has target 0 and its rows are taken once. Rows with the same id draw the same number and follow the text's hash
    (``tie``); repeated rows count as one unit and share a verdict. The unit at the edge of a budget is taken when
    that brings the source nearer to its target. An empty table gives an empty result.
    """
    t = F.col(f"`{text}`")
    drawn = stage(df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(t).alias("size"),
        (-F.log(uniform(seed, F.col(f"`{id_col}`"))) / quality_weight(t)).alias("key"),
        F.xxhash64(F.coalesce(t, F.lit(""))).alias("tie")), "mix-drawn")
    targets = stage(source_targets(
        drawn.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit), "mix-targets")
    earlier = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = targets.select(F.col("source").alias("s"), "source_size", "target",
                           F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("start"))
    summed = running_totals(drawn, ["source", "key", "id", "tie"], {"reach": "size"}, "mix-order", peers=True)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    left = F.col("target") - whole * F.col("source_size")
    middle = F.col("reach") - F.col("start") - F.col("size") / 2  # half of the row's words are within the budget
    times = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.least(whole + (middle < left).cast("int"), F.lit(limit)))
    return (summed.join(start, F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target",
                    times.alias("epochs"), (times * F.col("size")).cast("long").alias("taken"), "tie"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix with ``df``'s columns: each row as often as it is taken."""
    names = [fresh(df.columns, f"_mix_{n}") for n in ("id", "source", "tie", "often")]
    verdict = (mix(df, id_col, source, text, **options).where("epochs > 0")
               .groupBy(F.col(id_col).alias(names[0]), F.col(source).alias(names[1]), F.col("tie").alias(names[2]))
               .agg(F.max("epochs").alias(names[3])))
    tie = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    same = (F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & F.col(f"`{source}`").eqNullSafe(F.col(names[1]))
            & (tie == F.col(names[2])))
    return (df.join(verdict, same).withColumn(names[3], F.explode(F.sequence(F.lit(1), F.col(names[3]))))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
