"""Shared pieces of the training-data operators: words, sizes, names, and the library's general helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendscope.functions.running import running_totals
from lendscope.session import forget
from lendscope.session import written as stage

__all__ = ["SPACES", "WORD", "forget", "fresh", "let", "running_totals", "stage", "utf8_size", "word_count", "words_of"]

#: Fixed value: white space between words (space and U+0009 to U+000D).
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts have none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return let(flat, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +")))


def word_count(text: Column) -> Column:
    """Number of words (long)."""
    return F.size(words_of(text)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that clashes with none of ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
