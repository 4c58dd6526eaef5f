"""Best-fit packing with exact complements, planned on counts of lengths.

Pieces of one length are alike, so the plan needs only how many there are of each length: at most ``capacity`` numbers,
whatever the input's size. The plan says which lengths share a sequence and how often; a piece finds its place by its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lumenframe.llm.common import whole_text, with_null, without_null
from lumenframe.session import materialise

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 600_000
LONGEST_CACHED = 64
MARKS = "!#$%&()*+,-./:;=?@[]^_`{}~"
#: White space for Python's split() that the tokenizer takes for symbols.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORDS: dict[str, "WordIds"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _ids(path: str, text: str) -> bytes:
    return array("I", _tokenizer(path).encode(text, add_special_tokens=False).ids).tobytes()


def _plain(letters: str) -> bool:
    """Letters that stay single letters in the tokenizer's normal form and in lower case."""
    return letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible bytes for themselves, others from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of words as bytes, computed when first asked for.

    A word is cut into letters and the marks after them, which the tokenizer takes for words of their own and
    lower-cases; letters in their normal form go to its model directly, all else through the whole tokenizer. The table
    is bounded: when it is full it becomes the older half, from which words in use come back.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path, self.older, self.model = path, {}, _tokenizer(path).model

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                lower = word if word.islower() else word.lower()
                if lower != word:
                    ids = self[lower] if _plain(word) else _ids(self.path, word)
                elif word.isascii():
                    ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
                elif _plain(word):
                    letters = word.encode("utf-8").decode("latin-1").translate(_byte_letters())
                    ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                else:
                    ids = _ids(self.path, word)
            else:
                core = word.rstrip(MARKS)
                if len(core) < len(word) and core[-1:].isalpha() and _plain(core[-1]):
                    ids = self[core] + self[word[len(core):]]
                else:
                    ids = _ids(self.path, word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def encode_text(path: str, text: str) -> bytes:
    """Token ids as little-endian unsigned 32-bit numbers.

    The tokenizer splits at white space, so a text's ids are those of its words in turn. Texts with control characters
    that only Python takes for white space go through whole.
    """
    if any(c in text for c in ODD_SPACES):
        return _ids(path, text)
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return b"".join(map(_WORDS[path].__getitem__, text.split()))


def _piece_maker(path: str, capacity: int, end_id: int) -> Callable:
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.iloc[at:at + 1024]
                out = []
                for doc, no_id, text in zip(rows["id"], rows["no_id"], rows["text"]):
                    ids = encode_text(path, text) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start:start + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc, no_id, piece, start // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pd.DataFrame(out, columns=["id", "no_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        if path in _WORDS:
            _WORDS[path].older = {}  # the worker process lives on and may run other work
    return pieces


class _Counts:
    """How many pieces there are of each length, and in how many ways two of them make each sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, k in counts.items():
            self.n[length] = k
        self.ways = np.zeros(2 * capacity + 1, dtype=np.int64)
        self.there = np.zeros(capacity + 1, dtype=bool)
        lengths = np.flatnonzero(self.n)
        for length in lengths:
            self._pairs(int(length), 1)
            self.there[length] = True
            if self.n[length] > 1:
                self.ways[2 * length] += 1

    def _pairs(self, length: int, sign: int) -> None:
        """Pairs of this length with others that are there (without itself)."""
        others = np.flatnonzero(self.there)
        others = others[others != length]
        self.ways[others + length] += sign

    def take(self, length: int, k: int) -> None:
        old, new = int(self.n[length]), int(self.n[length]) - k
        self.n[length] = new
        if old > 1 and new <= 1:
            self.ways[2 * length] -= 1
        if new == 0:
            self.there[length] = False
            self._pairs(length, -1)

    def pair(self, gap: int) -> tuple[int, int] | None:
        if gap < 2 or self.ways[gap] <= 0:
            return None
        a = np.arange((gap + 1) // 2, gap)
        good = self.there[a] & self.there[gap - a]
        if gap % 2 == 0 and self.n[gap // 2] < 2:
            good &= a != gap // 2
        hits = np.flatnonzero(good)
        return (int(a[hits[-1]]), int(gap - a[hits[-1]])) if len(hits) else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        c = np.flatnonzero(self.there[:max(0, gap - 1)])
        c = c[self.ways[gap - c] > 0][::-1]
        for x in c:
            x = int(x)
            self.take(x, 1)
            rest = self.pair(gap - x)
            self._give(x)
            if rest:
                return (x, *rest)
        return None

    def _give(self, length: int) -> None:
        self.n[length] += 1
        if self.n[length] == 2:
            self.ways[2 * length] += 1
        if self.n[length] == 1:
            self._pairs(length, 1)
            self.there[length] = True

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.there[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences as ``([(length, times), ...], how many such sequences)``.

    The longest piece left opens a sequence. A single, a pair or a triple of lengths that fills the gap exactly is taken
    if there is one; else the longest that fits goes in and the smaller gap is tried again.
    """
    left = _Counts(counts, capacity)
    plan = []
    longest = capacity
    while True:
        while longest > 0 and not left.there[longest]:
            longest -= 1
        if longest == 0:
            return plan
        chosen = {longest: 1}
        left.take(longest, 1)
        gap = capacity - longest
        while gap > 0:
            fill = left.exact(gap)
            if fill is None:
                below = np.flatnonzero(left.there[1:gap + 1])
                if not len(below):
                    break
                fill = (int(below[-1]) + 1,)
            for length in fill:
                chosen[length] = chosen.get(length, 0) + 1
                left.take(length, 1)
                gap -= length
        more = min(int(left.n[length]) // times for length, times in chosen.items())
        if more:
            for length, times in chosen.items():
                left.take(length, more * times)
        plan.append((list(chosen.items()), more + 1))


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, times in a sequence, first sequence, offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for lengths, many in plan:
        offset = 0
        for length, times in lengths:
            rows.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * times
        sequence += many
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def _placer(where: dict[int, np.ndarray]) -> Callable:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                length = int(lengths[own[0]])
                table = where[length]
                hit = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1]
                beyond = ranks[own] - hit[:, 0]
                sequence[own] = hit[:, 2] + beyond // hit[:, 1]
                offset[own] = hit[:, 3] + beyond % hit[:, 1] * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
    return place


def pack(df: DataFrame, id: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one ``end_id``; only documents longer than ``capacity`` are cut. Null texts are
    empty and give one piece of length 1. Repeated rows are packed as often as they occur; an empty table gives an
    empty result. ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    path = tokenizer or tokenizer_path()
    rows = df.select(*without_null(id), whole_text(text).alias("text"))
    pieces = materialise(rows.mapInPandas(
        _piece_maker(path, capacity, end_id),
        "id long, no_id boolean, piece int, start long, length long, ids_crc32 long, part long, rank long"), "pieces")
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = materialise(parts, "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan_sequences(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts.hint("merge"), ["length", "part"]).select(
        "id", "no_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    placed = ranked.mapInPandas(_placer(where), "id long, no_id boolean, piece int, start long, length long, ids_crc32 long, "
                                                "sequence_id long, offset long")
    return placed.select(with_null(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
