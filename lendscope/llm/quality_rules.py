"""Quality rules: one table of thresholds, compiled into one projection without user functions.

Every measure of a text is an expression of built-in functions over that row alone: no shuffle, no Python. Repeated
five-word windows are found inside the row by hashing words, hashing windows and sorting the windows of those texts
that repeat one (n log n in the text's length).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"()"
WINDOW = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or that the their they this "
    "to was we were which with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für ich im ist mit nach "
    "nicht sein sich sie sind und von war wie zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour qu que "
    "qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos entre era esta este fue ha han hay las lo los más me mi muy no para pero por se ser "
    "sin sobre su sus también te un una uno y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is rejected when ``100 * measure > limit * base`` (or ``<`` for ``least``) and it has ``from_words`` words."""

    measure: str
    base: str
    limit: int
    least: bool = False
    from_words: int = 0


#: The threshold table: per cent of the base measure.
RULES = (
    Rule("word_chars", "n_words", 2000),              # mean word length over 20 characters
    Rule("word_chars", "n_words", 200, least=True),   # or under 2
    Rule("n_symbols", "n_words", 15),                 # symbols a word
    Rule("n_bangs", "n_words", 40),                   # exclamation marks a word
    Rule("n_upper", "word_chars", 45, from_words=20), # text in capitals
    Rule("n_stop_words", "n_words", 2, least=True, from_words=40),
    Rule("n_dup_lines", "n_lines", 50, from_words=20),
)
MIN_WORDS = 10
MAX_REPEATED = 20


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _covered(windows: Column) -> Column:
    """Number of word positions inside windows that occur twice or more."""

    def cover(tagged: Column) -> Column:  # (hash, start) in order
        last = F.size(tagged) - 1
        twice = lambda j: (
            ((j > 0) & (tagged[F.greatest(j - 1, F.lit(0))]["h"] == tagged[j]["h"]))
            | ((j < last) & (tagged[F.least(j + 1, last)]["h"] == tagged[j]["h"])))
        starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda j: tagged[j]["i"]))
        return let(starts, lambda s: F.aggregate(
            F.sequence(F.lit(0), F.size(s) - 1), F.lit(0).cast("long"),
            lambda acc, j: acc + F.when(j == F.size(s) - 1, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), s[F.least(j + 1, F.size(s) - 1)] - s[j]))))

    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(tagged, cover))


def _repeat_words(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + d] for d in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        let(hashed, lambda h: let(windows(h), _covered)))


def assess(text: Column) -> Column:
    """Struct of every measure, ``base_failed`` and ``kept`` for one text; NULL counts as the empty text."""
    text = F.coalesce(text, F.lit(""))

    def measures(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        bare = words_of(F.lower(F.translate(t, PUNCTUATION, "")))
        return let(lines, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            _count_chars(t, SYMBOLS).alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            _count_chars(t, "!").alias("n_bangs"),
            _count_chars(t, UPPER).alias("n_upper"),
            F.size(F.filter(bare, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words")))

    def verdict(m: Column) -> Column:
        base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
        rejected = base_failed
        for r in RULES:
            value, bound = 100 * m[r.measure], r.limit * m[r.base]
            rejected = rejected | ((m["n_words"] >= r.from_words) & ((value < bound) if r.least else (value > bound)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_stop_words")
        return F.struct(*[m[n].alias(n) for n in names], base_failed.alias("base_failed"), (~rejected).alias("kept"))

    return let(text, lambda t: let(words_of(t), lambda w: let(measures(t, w), verdict)))


def quality_rules(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add the struct column ``out`` of measures and verdict for every row; all rows stay.

    NULL and blank texts have no words and fail the base rule. Rows are judged one by one, so ties, repeated rows,
    NULLs elsewhere and empty tables need no rule; a column named ``out`` is replaced.
    """
    return df.withColumn(out, assess(F.col(f"`{text}`")))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows whose text passes every rule, columns unchanged."""
    return df.filter(assess(F.col(f"`{text}`"))["kept"])
