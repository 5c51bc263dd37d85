"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into units that no piece of the vocabulary crosses. Each unit starts as characters; an agenda holds the
candidate merges of neighbours, best piece first, leftmost first. A candidate is skipped when the keyed hash of
(seed, text's key, unit's place in the text, place, piece) falls below the dropout rate, so segmentations vary between
units' occurrences and between seeds, repeat exactly in every run, and decode to the same text. Characters outside the
vocabulary, and the literal space mark, are written as byte pieces. Occurrences of a unit that skip the same merges have
the same pieces, so a task encodes those once, many at a time, and then looks them up; long units have a heap for their
agenda, short ones a row of a matrix. Ids are decoded a stretch of rows at a time, by Arrow.
"""

from __future__ import annotations

import copy
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
DROPOUT = 0.1
#: Units, and results with merges skipped (half of them the latest, half those in use before), that a task remembers.
REMEMBERED = 500_000
#: Candidates of a unit up to which its results are remembered: bits beside the unit's number.
BITS = 40
#: Occurrences among about a million characters from which a unit's results are remembered; rarer ones cost less anew.
OFTEN = 6
#: Bits of a place within a unit, beside the merge's rank in the agenda.
PLACE_BITS = 32


@dataclass
class Pieces:
    """A BPE vocabulary: ``ids`` by piece, ``merges`` (pair of neighbours -> piece), the merge order of each piece (equal
    scores share a number), bytes for decoding, ids of the byte pieces, and the pattern that cuts a text into units."""

    ids: dict[str, int]
    chars: dict[str, int]    # single characters, also those that occur only inside pieces (numbered behind the pieces)
    merges: dict[int, int]   # left id << 32 | right id
    order: list[int]
    surface: list[bytes]
    byte_ids: list[int]
    units: str


def load(path: str = VOCABULARY) -> Pieces:
    """Read a vocabulary file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, surface, byte_ids = {}, [], [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        rank.append(-sp.get_score(i))
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            ids[piece] = i
            surface.append(piece.replace(MARK, " ").encode())
    chars = {c: ids[c] if c in ids else len(surface) + k for k, c in enumerate(sorted({c for piece in ids for c in piece}))}
    known = ids | chars
    merges = {known[piece[:k]] << 32 | known[piece[k:]]: i for piece, i in ids.items() for k in range(1, len(piece))
              if piece[:k] in known and piece[k:] in known}
    place = {r: k for k, r in enumerate(sorted(set(rank)))}
    return Pieces(ids, chars, merges, [place[r] for r in rank], surface, byte_ids, _units(ids))


def _units(ids: dict[str, int]) -> str:
    """Pattern of the smallest units that no piece crosses: spaces, then word characters or then others.

    Word characters that some piece joins with others count as others. Should a piece still cross, units run from
    space to space.
    """
    joint = {c for piece in ids for pair in re.findall(r"(?=(\w[^\w▁]|[^\w▁]\w))", piece) for c in pair if re.match(r"\w", c)}
    odd = re.escape("".join(sorted(joint)))
    finer = rf" *(?:[^\W{odd}]+|(?:(?! )[\W{odd}])+)| +"
    cut = re.compile(finer)
    return finer if all(len(cut.findall(piece.replace(MARK, " "))) == 1 for piece in ids) else r" *[^ ]+| +"


def encode_unit(unit: str, p: Pieces, key: int, dropout: float) -> bytes:
    """Ids of one unit (int32, packed); ``key`` decides with the place and piece which merges are skipped."""
    merges, order = p.merges, p.order
    known = p.chars.get
    symbols = [known(MARK) if c == " " else -1 if c == MARK else known(c, -1) for c in unit]
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    candidate = [-1] * n  # the piece that the symbol at a place and its neighbour would become
    limit = int(dropout * 65536)
    agenda: list[int] = []

    def propose(i: int) -> None:
        j = after[i]
        k = -1
        if j < n:
            k = merges.get(symbols[i] << 32 | symbols[j], -1) if symbols[i] >= 0 <= symbols[j] else -1
            if k >= 0:
                if limit and ((key ^ (i * 0x9E3779B1 + k * 0x85EBCA77)) * 0xC2B2AE3D27D4EB4F >> 40 & 0xFFFF) < limit:
                    k = -1
                else:
                    heapq.heappush(agenda, order[k] << PLACE_BITS | i)
        candidate[i] = k

    for i in range(n - 1):
        propose(i)
    low = (1 << PLACE_BITS) - 1
    while agenda:
        best = heapq.heappop(agenda)
        i = best & low
        k = candidate[i]
        if k < 0 or order[k] != best >> PLACE_BITS:
            continue  # a neighbour has merged meanwhile
        j = after[i]
        symbols[i] = k
        candidate[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            propose(before[i])
        propose(i)
    out: list[int] = []
    i, pieces = 0, len(p.surface)
    while i < n:
        if 0 <= symbols[i] < pieces:
            out.append(symbols[i])
        else:  # one character without a piece of its own
            out.extend(p.byte_ids[b] for b in unit[i].encode())
        i = after[i]
    return array("i", out).tobytes()


class Agenda:
    """Encodes many short units at once: a row of a matrix is a unit's agenda, and each round takes every row's best
    candidate (the leftmost of equals). Gives what ``encode_unit`` gives.

    A candidate is one number, merge order above and piece below. Pieces of equal score, which only runs of spaces can
    become, would be told apart by it, so units that open with several spaces are left to ``encode_unit``.
    """

    WIDEST = 32
    ROWS = 4096
    PIECE = 15  # bits of a piece in a candidate
    NONE = np.int32(2**31 - 1)

    def __init__(self, p: Pieces, dropout: float):
        self.p, self.dropout, self.limit = p, dropout, int(dropout * 65536)
        pair = np.array(list(p.merges), dtype=np.int64)
        merged = np.array(list(p.merges.values()), dtype=np.int64)
        self._index((pair >> 32 << 20) + (pair & 0xFFFFFFFF), (np.array(p.order, dtype=np.int64)[merged] << self.PIECE | merged).astype(np.int32))
        self.fits = len(p.order) <= 1 << self.PIECE  # larger vocabularies keep to ``encode_unit``
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for c, i in p.chars.items():
            self.char[ord(c)] = i
        self.char[32], self.char[ord(MARK)] = p.chars[MARK], -1

    def _index(self, pairs: np.ndarray, codes: np.ndarray) -> None:
        """Put the merges into a table by the hash of their pair; one that finds its slot taken goes to the next free one."""
        bits = len(pairs).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.pairs = np.full((1 << bits) + len(pairs), -1, dtype=np.int64)  # ids are below 2^20: no pair is negative
        self.codes = np.full(len(self.pairs), self.NONE, dtype=np.int32)
        slot = self._slot(pairs)
        while len(pairs):
            _, one = np.unique(slot, return_index=True)
            one = one[self.pairs[slot[one]] < 0]
            self.pairs[slot[one]], self.codes[slot[one]] = pairs[one], codes[one]
            pairs, codes, slot = (np.delete(x, one) for x in (pairs, codes, slot))
            slot += 1

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _propose(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Candidate merges of neighbours; NONE where there is none or it is skipped."""
        pair = left.astype(np.int64) * (1 << 20) + right
        slot = self._slot(pair)
        held = self.pairs[slot]
        code = self.codes[slot]
        other = np.flatnonzero(held != pair)
        code[other] = self.NONE
        other = other[held[other] >= 0]
        while len(other):
            slot[other] += 1
            held = self.pairs[slot[other]]
            same = held == pair[other]
            code[other[same]] = self.codes[slot[other[same]]]
            other = other[~same & (held >= 0)]
        if self.limit:
            good = np.flatnonzero(code < self.NONE)
            mark = place[good].astype(np.uint64) * np.uint64(0x9E3779B1) + (code[good] & ((1 << self.PIECE) - 1)).astype(np.uint64) * np.uint64(0x85EBCA77)
            draw = (key[good] ^ mark) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40) & np.uint64(0xFFFF)
            code[good[draw < self.limit]] = self.NONE
        return code

    def takes(self, unit: str) -> bool:
        return self.fits and len(unit) <= self.WIDEST and unit[:2] != "  "

    def __call__(self, units: list[str], keys: Sequence[int] | np.ndarray, trace: list | None = None) -> list[bytes]:
        """Packed ids of the units, in their order; ``trace`` takes the merges made (units, places, pieces), heaps apart."""
        out: list = [b""] * len(units)
        keys = np.asarray(keys, dtype=np.uint64)
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        size[[u[:2] == "  " for u in units] if self.fits else slice(None)] += self.WIDEST
        by = np.argsort(size, kind="stable")
        short = by[: np.searchsorted(size[by], self.WIDEST, "right")]
        for a in range(0, len(short), self.ROWS):
            rows = short[a:a + self.ROWS]
            at = rows.tolist()
            self._short([units[r] for r in at], keys[rows], rows, size[rows], out, trace)
        for r in by[len(short):].tolist():
            out[r] = encode_unit(units[r], self.p, int(keys[r]), self.dropout)
        return out

    def _short(self, units: list[str], key: np.ndarray, rows: np.ndarray, size: np.ndarray, out: list, trace: list | None) -> None:
        n, width = len(units), int(size[-1]) + 1  # a row ends with a column of padding, which also stands before the next row
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = np.full((n, width), -2, dtype=np.int32)  # -2: padding, or merged into the symbol before it
        symbol[np.arange(width) < size[:, None]] = self.char[points]
        symbol = symbol.ravel()
        after = np.arange(1, n * width + 1)
        before = np.arange(-1, n * width - 1)
        code = np.full(n * width, self.NONE, dtype=np.int32)
        code[:-1] = self._propose(symbol[:-1], symbol[1:], np.tile(np.arange(width), n)[:-1], np.repeat(key, width)[:-1])
        row = np.arange(n)  # the rows that ``code`` has
        while True:
            best = code.reshape(-1, width).argmin(1)
            least = code[np.arange(len(row)) * width + best]
            busy = np.flatnonzero(least < self.NONE)
            if len(busy) <= len(row) * 3 // 4:  # the others have ended
                if not len(busy):
                    break
                row, best, least, code = row[busy], best[busy], least[busy], code.reshape(-1, width)[busy].ravel()
                busy = np.arange(len(row))
            r, i, made = row[busy], best[busy], least[busy] & ((1 << self.PIECE) - 1)
            start, shift = r * width, (busy - r) * width  # of a row in ``symbol``; from there to ``code``
            if trace is not None:
                trace.append((rows[r], i, made))
            here = start + i
            gone = after[here]
            left, right = before[here], after[gone]
            symbol[here], symbol[gone], code[gone + shift] = made, -2, self.NONE
            after[here] = right
            before[right] = here
            found = self._propose(np.concatenate([symbol[left], made]), np.concatenate([made, symbol[right]]),
                                  np.concatenate([left - start, i]), np.tile(key[r], 2))
            code[left + shift], code[here + shift] = found[:len(r)], found[len(r):]
        self._finish(units, rows, symbol.reshape(n, width), out)

    def _finish(self, units: list[str], rows: np.ndarray, symbol: np.ndarray, out: list) -> None:
        full = symbol != -2
        odd = ((symbol == -1) | (symbol >= len(self.p.surface))).any(1)
        packed = symbol[full].tobytes()
        ends = np.cumsum(full.sum(1)) * 4
        for r, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[r] = packed[a:b]
        for k in np.flatnonzero(odd).tolist():
            ids: list[int] = []
            for i in np.flatnonzero(full[k]).tolist():
                if 0 <= (x := int(symbol[k, i])) < len(self.p.surface):
                    ids.append(x)
                else:
                    ids.extend(self.p.byte_ids[byte] for byte in units[k][i].encode())
            out[rows[k]] = array("i", ids).tobytes()


class Encoder:
    """Encodes whole texts; every unit's occurrence skips merges by its own key (seed, text's key, place in the text).

    Nothing is shared between occurrences but results that are equal: a unit's result without dropout serves those that
    skip none of the merges made on the way to it, and any other result is remembered under the unit and all candidates
    skipped, a bit each. Units are numbered for this when a call has them ``OFTEN`` times; the others, long ones and those
    with more than ``bits`` candidates run for each occurrence.
    """

    STRETCH = 16384  # occurrences whose candidates are tested at once

    def __init__(self, pieces: Pieces, seed: int, dropout: float, bits: int = BITS):
        self.pieces, self.seed, self.bits = pieces, seed & (1 << 64) - 1, bits
        self.cut = re.compile(pieces.units)
        self.agenda = Agenda(pieces, dropout)
        self.plain = copy.copy(self.agenda)  # the same tables
        self.plain.dropout = self.plain.limit = 0
        self.stems = {piece[:k]: -1 for piece in pieces.ids for k in range(2, len(piece))} | pieces.ids
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}  # -1: too many candidates
        self.whole: list[bytes] = []  # results without dropout
        self.path = np.zeros(0, dtype=np.int64)  # the merges made on the way to them, a bit each
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # candidates in ``marks``
        self.marks = np.zeros(0, dtype=np.uint64)
        self.latest: dict[int, bytes] = {}
        self.earlier: dict[int, bytes] = {}

    def __call__(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Packed int32 ids of the texts."""
        if len(self.units) > REMEMBERED:
            self._forget()
        if len(self.latest) > REMEMBERED // 2:
            self.earlier, self.latest = self.latest, {}
        units: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                units += self.cut.findall(" " + text)
            ends.append(len(units))
        number = np.fromiter(map(self.units.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        rest = np.flatnonzero(number < 0).tolist()
        tally = Counter([units[k] for k in rest])
        self._learn([u for u, n in tally.items() if n >= OFTEN and len(u) <= Agenda.WIDEST and u not in self.units])
        number[rest] = [self.units.get(units[k], -1) for k in rest]
        key = self._keys(keys, np.diff(ends))
        ids: list = list(map((self.whole or [b""]).__getitem__, number.tolist()))  # -1 takes any, and is set below
        for a in range(0, len(units) if self.agenda.limit else 0, self.STRETCH):
            here = slice(a, a + self.STRETCH)
            skipped = self._skipped(number[here], key[here])
            varied = np.flatnonzero(skipped & np.append(self.path, 0)[number[here]])
            if len(varied):
                self._vary(a + varied, (number[here][varied] << self.bits | skipped[varied]).tolist(), units, key, ids)
        alone = np.flatnonzero(number < 0)
        for k, x in zip(alone.tolist(), self.agenda([units[k] for k in alone.tolist()], key[alone]), strict=True):
            ids[k] = x
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _keys(self, keys: list[int], sizes: np.ndarray) -> np.ndarray:
        """A key for every unit: the stream of its text's key, at its place."""
        of_text = [xxhash.xxh64_intdigest((k & (1 << 64) - 1).to_bytes(8, "little"), self.seed) for k in keys]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x = np.repeat(np.array(of_text, dtype=np.uint64), sizes) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)

    def _skipped(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The candidates that each occurrence skips, a bit each."""
        count, first = np.append(self.count, 0)[number], np.append(self.first, 0)[number]
        owner = np.repeat(np.arange(len(number)), count)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        draw = (key[owner] ^ self.marks[first[owner] + bit]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40) & np.uint64(0xFFFF)
        hit = np.flatnonzero(draw < self.agenda.limit)
        out = np.zeros(len(number), dtype=np.int64)
        if len(hit):
            starts = np.flatnonzero(np.diff(owner[hit], prepend=-1))
            out[owner[hit][starts]] = np.add.reduceat(np.int64(1) << bit[hit], starts)
        return out

    def _vary(self, places: np.ndarray, codes: list[int], units: list[str], key: np.ndarray, ids: list) -> None:
        """Set ``ids`` at ``places``; a code is the unit's number and the candidates skipped."""
        latest, at = self.latest, places.tolist()
        known = list(map(latest.get, codes))
        wanted = {c: k for c, k, x in zip(codes, at, known, strict=True) if x is None}
        if wanted:
            past = {c: x for c in wanted if (x := self.earlier.get(c)) is not None}
            latest.update(past)
            new = [(c, k) for c, k in wanted.items() if c not in past]
            latest.update(zip([c for c, _ in new], self.agenda([units[k] for _, k in new], key[[k for _, k in new]]), strict=True))
            known = map(latest.__getitem__, codes)
        for k, x in zip(at, known, strict=True):
            ids[k] = x

    def _candidates(self, unit: str) -> list[tuple[int, int]]:
        """Places and pieces of all stretches of a unit that are a piece; no run of the agenda proposes anything else."""
        out = []
        s = unit.replace(MARK, "\0").replace(" ", MARK)
        for i in range(len(s) - 1):
            for j in range(i + 2, len(s) + 1):
                k = self.stems.get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    out.append((i, k))
        return out

    def _learn(self, units: list[str]) -> None:
        """Number units; set their candidates, results without dropout and the merges made on the way."""
        found = list(map(self._candidates, units))
        self.units.update([(u, -1) for u, x in zip(units, found, strict=True) if len(x) > self.bits])
        units, found = [u for u, x in zip(units, found, strict=True) if len(x) <= self.bits], [x for x in found if len(x) <= self.bits]
        if not units:
            return
        self.units.update(zip(units, range(len(self.whole), len(self.whole) + len(units)), strict=True))
        place, made = np.array([x for one in found for x in one], dtype=np.int64).reshape(-1, 2).T
        count = np.array(list(map(len, found)), dtype=np.int64)
        first = np.cumsum(count) - count
        trace: list[tuple] = []
        self.whole += self.plain(units, [0] * len(units), trace)
        row, at, piece = (np.concatenate([[], *x]).astype(np.int64) for x in (zip(*trace, strict=True) if trace else ((), (), ())))
        code = np.repeat(np.arange(len(units)), count) << 40 | place << 20 | made
        order = np.argsort(code)
        path = np.zeros(len(units), dtype=np.int64)
        if len(row):
            np.bitwise_or.at(path, row, np.int64(1) << order[np.searchsorted(code[order], row << 40 | at << 20 | piece)] - first[row])
        heap = [not self.plain.takes(u) for u in units]
        path[heap] = (np.int64(1) << count[heap]) - 1  # not traced: any candidate may be on the way
        self.path, self.count = np.append(self.path, path), np.append(self.count, count)
        self.first = np.append(self.first, first + len(self.marks))
        mark = place.astype(np.uint64) * np.uint64(0x9E3779B1) + made.astype(np.uint64) * np.uint64(0x85EBCA77)
        self.marks = np.append(self.marks, mark)


def encode(df: DataFrame, pieces: Pieces, key: Column, text: str = "text", out: str = "ids", seed: int = 1,
           dropout: float = DROPOUT) -> DataFrame:
    """Add ``out`` (array<int>) to ``df``: the pieces of every whole text.

    ``key`` (long) with the unit's place in the text decides which merges are skipped; a NULL key counts as 0. NULL text gives NULL ids, the empty text none. A column named ``out`` is replaced. Rows are
    independent: ties, repeats and other columns do not matter.
    """
    held = df.sparkSession.sparkContext.broadcast(pieces)
    rest = [c for c in df.columns if c.lower() != out.lower()]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Encoder(held.value, seed, dropout)
        for batch in batches:
            texts, keys = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _slices(pc.utf8_length(texts)):
                part = texts.slice(a, b - a).to_pylist()
                ids = run([t or "" for t in part], keys[a:b])
                ids = [None if t is None else np.frombuffer(x, dtype=np.int32) for t, x in zip(part, ids, strict=True)]
                yield _batch([*(c.slice(a, b - a) for c in batch.columns[:-2]), pa.array(ids, pa.list_(pa.int32()))])

    return _mapped(df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"), F.coalesce(key.cast("long"), F.lit(0))),
                   encoded, rest, out, "array<int>")


def _slices(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about a million characters or ids; a longer row is alone."""
    size, a = 0, 0
    for k, n in enumerate(sizes.fill_null(0).to_pylist()):
        if size and size + n > 1 << 20:
            yield a, k
            a, size = k, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])


def _mapped(sent: DataFrame, task: Callable, rest: list[str], out: str, kind: str) -> DataFrame:
    """``task`` over ``sent`` under plain column names; the result has ``rest`` and ``out`` of type ``kind``."""
    plain = sent.toDF(*[f"c{k}" for k in range(len(sent.columns))])
    schema = StructType([*plain.schema.fields[: len(rest)], StructField(f"c{len(rest)}", DataType.fromDDL(kind))])
    return plain.mapInArrow(task, schema).toDF(*rest, out)


def decode_lists(ids: pa.Array, surface: pa.Array) -> pa.Array:
    """The texts of many sequences of ids at once, as ``decode_ids`` gives them; it raises where it cannot."""
    flat = ids.flatten()
    if flat.null_count:
        raise pa.ArrowInvalid("an id is NULL")
    ends = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
    parts = pa.ListArray.from_arrays(np.append(np.int32(0), ends), surface.take(flat))
    texts = pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).cast(pa.large_string())
    texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
    return pc.if_else(ids.is_valid(), texts, None).cast(pa.string())


def decode_ids(ids: list[int], surface: list[bytes]) -> str:
    """The text of a sequence of ids (the space that encoding puts in front is taken off)."""
    text = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (string) to ``df``: the text of ``ids``. NULL ids give NULL; bytes that are no UTF-8 are replaced."""
    held = df.sparkSession.sparkContext.broadcast(pieces)

    rest = [c for c in df.columns if c.lower() != out.lower()]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = held.value.surface
        shown = pa.array(surface, pa.large_binary())
        for batch in batches:
            for a, b in _slices(pc.list_value_length(batch.columns[-1])):
                found = batch.columns[-1].slice(a, b - a)
                try:
                    texts = decode_lists(found, shown)
                except (pa.ArrowInvalid, IndexError):  # bytes that are no UTF-8, or ids that are not plain places
                    texts = pa.array([decode_ids(x.values.tolist(), surface) if x.is_valid else None for x in found], pa.string())
                yield _batch([*(c.slice(a, b - a) for c in batch.columns[:-1]), texts])

    return _mapped(df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`")), decoded, rest, out, "string")
