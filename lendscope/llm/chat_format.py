"""Chat formatting: roles of transcript lines by a hidden Markov model and Viterbi, then canonical turns.

States are the roles; a line shows a speaker marker ("User:", "### Assistant:", "<|system|>", ...) or none, its place
(first of its transcript or not), its length and its shape. Starts, changes of role and emissions are counted over all
lines whose role is known. All lines stand in one global order in which a transcript's start resets the chain, so the
best path is that of one long sequence: it is cut into blocks of bounded length, each block is reduced to the best
score from each entry to each exit state (max-plus products), the blocks' states are decided level by level, and each
block then finds its lines' states between its given ends. The path is exact, and no transcript is ever one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import running_totals, stage

ROLES = ("system", "user", "assistant")
#: Names that speaker markers give the roles.
ALIASES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "q", "question", "prompter", "customer", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "gpt", "chatbot", "agent", "response", "model"),
}
#: A line that opens with a name and a colon, or with a bracketed name alone.
MARKER = (r"^\s*(?:(?:#{1,6}\s*|\*\*|\[|<\|?)?(?:im_start\|?>\s*)?([A-Za-z][A-Za-z_ ]{0,20}?)"
          r"(?:(?:\*\*|\]|\|?>)?\s*:(?:\*\*)?|\]|\|>|>))")
#: What belongs to a marker behind it: blanks to the end of its line, or one blank.
BEHIND = r"(?:[ \t]*\r?\n|[ \t])?"
FEATURES = ("marker", "position", "length", "shape")
#: Counts added to every cell, and to a marker's own role.
SMOOTH, MARKED = 0.5, 200.0
BLOCK = 1024


@dataclass
class ChatModel:
    start: np.ndarray                     # log-probability of a first line's role
    change: np.ndarray                    # log-probability of a role after a role
    emit: dict[str, dict[str, np.ndarray]]  # feature -> value -> log-probability for each role
    rare: dict[str, np.ndarray]           # feature -> log-probability of values never counted


def marker_role(text: Column) -> Column:
    """Role that the line's speaker marker names, "other" for an unknown name, "none" without marker."""
    name = F.lower(F.trim(F.regexp_extract(text, MARKER, 1)))
    out = F.when(name == "", F.lit("none"))
    for role, names in ALIASES.items():
        out = out.when(name.isin(*names), F.lit(role))
    return out.otherwise(F.lit("other"))


def body_of(text: Column) -> Column:
    """The line without a marker that names a role; white space stays as it is."""
    text = F.coalesce(text, F.lit(""))
    return F.when(marker_role(text).isin(*ROLES), F.regexp_replace(text, MARKER + BEHIND, "")).otherwise(text)


def escaped(text: Column) -> Column:
    """A text that cannot be read as a delimiter: ``<`` and ``|`` are kept apart by one more backslash than there is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def features(text: Column, first: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    return {
        "marker": marker_role(text),
        "position": F.when(first, "first").otherwise("later"),
        "length": F.when(size == 0, "empty").otherwise(F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) * 2), F.lit(30)).cast("string")),
        "shape": F.when(F.rtrim(text).endswith("?"), "question").when(text.contains("\n"), "lines").otherwise("plain"),
    }


def ordered(df: DataFrame, id_col: str, turn: str, text: str, role: str | None) -> DataFrame:
    """Lines in one global order (written table): id, turn, text, role, place, first, and the features."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").alias("text"),
                     (F.col(f"`{role}`") if role else F.lit(None)).cast("string").alias("role"))
    rows = rows.select("id", "turn", F.xxhash64("text").alias("tie"), "text", "role", F.lit(1).cast("long").alias("one"))
    placed = stage(running_totals(rows, ["id", "turn", "tie"], {"place": "one"}, "chat-order"), "chat-placed")
    starts = placed.select("id", "place").groupBy("id").agg(F.min("place").alias("from"))
    first = F.col("place") == F.col("from")
    return stage(placed.join(starts.withColumnRenamed("id", "sid"), F.col("id").eqNullSafe(F.col("sid")))
                 .select("id", "turn", "text", "role", (F.col("place") - 1).alias("place"), first.alias("first"),
                         *[c.alias(n) for n, c in features(F.col("text"), first).items()]), "chat-lines")


def fit(lines: DataFrame, known: Column) -> ChatModel:
    """Count starts, changes and emissions over the lines of ``ordered`` with a known role where ``known`` holds."""
    said = lines.where(known & F.col("role").isin(*ROLES))
    number = {r: i for i, r in enumerate(ROLES)}
    start, change = np.full(3, SMOOTH), np.full((3, 3), SMOOTH)
    for r in said.where("first").groupBy("role").count().collect():
        start[number[r[0]]] += r[1]
    before = said.select((F.col("place") + 1).alias("place"), F.col("role").alias("previous"))
    for r in said.where("not first").join(before, "place").groupBy("previous", "role").count().collect():
        change[number[r[0]], number[r[1]]] += r[2]
    cells = said.select("role", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in FEATURES])).alias("x"))
    emit: dict[str, dict[str, np.ndarray]] = {n: {} for n in FEATURES}
    for role in ROLES:  # markers mean their role, whatever the table holds
        emit["marker"].setdefault(role, np.full(3, SMOOTH))[number[role]] += MARKED
    for r in cells.groupBy("x.f", "x.v", "role").count().collect():
        emit[r[0]].setdefault(r[1], np.full(3, SMOOTH))[number[r[2]]] += r[3]
    totals = {n: sum(v.values(), np.full(3, SMOOTH)) for n, v in emit.items()}
    return ChatModel(np.log(start / start.sum()), np.log(change / change.sum(1, keepdims=True)),
                     {n: {k: np.log(x / totals[n]) for k, x in v.items()} for n, v in emit.items()},
                     {n: np.log(SMOOTH / t) for n, t in totals.items()})


def _steps(pdf: pd.DataFrame, model: ChatModel) -> np.ndarray:
    """The lines' matrices: score of each state after each state."""
    emit = np.zeros((len(pdf), 3))
    for n in FEATURES:
        table, rare = model.emit[n], model.rare[n]
        emit += np.array([table.get(v, rare) for v in pdf[n]]).reshape(-1, 3)
    out = np.broadcast_to(model.change, (len(pdf), 3, 3)).copy()
    out[pdf["first"].to_numpy(dtype=bool)] = model.start
    return out + emit[:, None, :]


def _product(steps: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices, pairwise."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        a, b = steps[0:len(steps) - len(odd):2], steps[1::2]
        steps = np.concatenate([(a[:, :, :, None] + b[:, None, :, :]).max(2), odd])
    return steps[0]


def _inner(steps: np.ndarray, entry: int, exit_: int) -> np.ndarray:
    """Best states between a given entry state (before the first step) and exit state (after the last); -1: free."""
    score = steps[0, entry] if entry >= 0 else steps[0].max(0)
    back = np.zeros((len(steps), 3), dtype=np.int8)
    for k in range(1, len(steps)):
        through = score[:, None] + steps[k]
        back[k] = through.argmax(0)
        score = through.max(0)
    out = np.empty(len(steps), dtype=np.int64)
    out[-1] = exit_ if exit_ >= 0 else score.argmax()
    for k in range(len(steps) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def _states(steps: DataFrame, length: int) -> DataFrame:
    """(place, state): the best path through ``steps`` (place, m: nine scores), places 0 to length - 1."""
    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        m = np.stack(pdf["m"].to_numpy()).reshape(-1, 3, 3)
        return pd.DataFrame({"place": pdf["place"], "state": _inner(m, int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))})

    blocked = steps.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    if length <= BLOCK:
        return blocked.withColumns({"entry": F.lit(-1), "exit": F.lit(-1)}).groupBy("block").applyInPandas(path, "place long, state long")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"place": [pdf["block"].iloc[0]], "m": [_product(np.stack(pdf["m"].to_numpy()).reshape(-1, 3, 3)).ravel()]})

    above = stage(blocked.groupBy("block").applyInPandas(product, "place long, m array<double>"), "chat-blocks")
    ends = stage(_states(above, -(-length // BLOCK)), "chat-ends")  # each block's exit state
    entry = ends.select((F.col("place") + 1).alias("block"), F.col("state").alias("entry"))
    given = (blocked.join(ends.select(F.col("place").alias("block"), F.col("state").alias("exit")), "block")
             .join(entry, "block", "left").withColumn("entry", F.coalesce("entry", F.lit(-1))))
    return given.groupBy("block").applyInPandas(path, "place long, state long")


def recover_roles(lines: DataFrame, model: ChatModel) -> DataFrame:
    """Add ``role_pred`` to the lines of ``ordered``."""
    held = lines.sparkSession.sparkContext.broadcast(model)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"place": pdf["place"], "m": list(_steps(pdf, held.value).reshape(-1, 9))})

    steps = stage(lines.select("place", "first", *FEATURES).mapInPandas(matrices, "place long, m array<double>"), "chat-steps")
    states = _states(steps, lines.count())
    return lines.join(states, "place").withColumn("role_pred", F.element_at(F.array(*map(F.lit, ROLES)), (F.col("state") + 1).cast("int")))


def parse_transcripts(df: DataFrame, known: Column | None = None, id_col: str = "conv_id", turn: str = "turn", text: str = "text",
                      role: str | None = "role", model: ChatModel | None = None) -> DataFrame:
    """One row per line: id, turn, role_pred, opens, closes, rendered (plus ``role`` as given).

    The model is fitted on lines whose ``role`` is known and where ``known`` holds (an expression of ``id``), unless
    given. Lines of one transcript follow ``turn``, NULL first, then the text's hash; lines without id are one
    transcript. Neighbouring lines with the same recovered role are one canonical turn: the first opens it
    ("<|role|>" on a line of its own), the last closes it ("<|end|>"). ``rendered`` joined in order is the canonical
    conversation; delimiters inside a text are escaped (``unescaped`` takes that back); nothing is gathered by transcript.
    NULL text is an empty line. An empty table gives an empty result.
    """
    lines = ordered(df, id_col, turn, text, role)
    model = model or fit(lines, F.lit(True) if known is None else known)
    found = stage(recover_roles(lines, model).select("id", "turn", "text", "role", "place", "first", "role_pred"), "chat-roles")
    near = found.select("place", "first", "role_pred")
    ahead = near.select((F.col("place") - 1).alias("place"), F.col("first").alias("ahead_first"), F.col("role_pred").alias("ahead_role"))
    past = near.select((F.col("place") + 1).alias("place"), F.col("role_pred").alias("past_role"))
    both = found.join(past, "place", "left").join(ahead, "place", "left")
    opens = F.col("first") | ~F.col("past_role").eqNullSafe(F.col("role_pred"))
    closes = F.coalesce(F.col("ahead_first"), F.lit(True)) | ~F.col("ahead_role").eqNullSafe(F.col("role_pred"))
    rendered = F.concat(F.when(opens, F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"))).otherwise(""), escaped(body_of(F.col("text"))),
                        F.when(closes, F.lit("\n<|end|>\n")).otherwise("\n"))
    return both.select(F.col("id").alias(id_col), F.col("turn").alias(turn), "role", "role_pred",
                       opens.alias("opens"), closes.alias("closes"), rendered.alias("rendered"))


def transcript_lines(df: DataFrame, id_col: str = "conv_id", text: str = "transcript") -> DataFrame:
    """Lines of raw transcripts: conv_id, turn (line number from 0), text. NULL transcripts have no lines."""
    return df.select(F.col(f"`{id_col}`").alias("conv_id"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("turn", "text"))
