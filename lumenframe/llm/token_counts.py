"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character; dynamic programming carries the
best score and the number of pieces. Ties follow the tokenizer: of equal scores the piece that starts earlier stays.
A character that no piece covers alone may be unknown, at ten below the least score; neighbouring unknowns are one token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.common import whole_text, with_null, without_null

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
LONGEST_CACHED = 64
_COUNTS: dict[str, "WordCounts"] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file as a unigram vocabulary: the score falls with the logarithm of the rank.

    Control, unknown and byte pieces have no text and are left out, and so are pieces with a blank behind their first
    character, which no word can hold.
    """
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [p for p in pieces if BLANK not in p[1:]]
    return [(p, -float(np.log(rank + 2.0))) for rank, p in enumerate(pieces)]


class Counter:
    """Counts the pieces of the best segmentation of a word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}

    def count(self, word: str) -> tuple[int, int]:
        """Number of pieces and of unknown ones among them."""
        n = len(word)
        single, best, pieces, unknowns, last = self.single, [0.0], [0], [0], [False]
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(n):
            top, start = None, 0
            own = []
            while match is not None and match[0] == end:
                own.append(match[1])
                match = next(matches, None)
            if len(own) > 1:
                own.sort(reverse=True)  # the longest piece starts earliest
            for size, score in own:
                value = score + best[end + 1 - size]
                if top is None or value > top:
                    top, start = value, end + 1 - size
            if word[end] not in single:
                value = self.unknown + best[end]
                if top is None or value > top:
                    best.append(value)
                    pieces.append(pieces[end] + (not last[end]))
                    unknowns.append(unknowns[end] + (not last[end]))
                    last.append(True)
                    continue
            best.append(top)
            pieces.append(pieces[start] + 1)
            unknowns.append(unknowns[start])
            last.append(False)
        return pieces[n], unknowns[n]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


class WordCounts(dict):
    """Counts of words as one number (pieces, and unknown ones above 32 bits), made when first asked for. The table is
    bounded: when it is full it becomes the older half, from which words in use come back."""

    def __init__(self, path: str):
        super().__init__()
        self.counter, self.older = _counter(path), {}

    def __missing__(self, word: bytes) -> int:
        both = self.older.get(word)
        if both is None:
            pieces, unknown = self.counter.count(BLANK + word.decode("utf-8"))
            both = pieces + (unknown << 32)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = both
        return both


def count_text(path: str, text: str) -> tuple[int, int, int]:
    """Words, pieces and unknown pieces of a text. Pieces don't cross white space, so words are counted alone."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(path)
    words = text.encode("utf-8").split()
    both = sum(map(_COUNTS[path].__getitem__, words))
    return len(words), both & 0xFFFFFFFF, both >> 32


def count_tokens(df: DataFrame, id: str, text: str, model: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_tokens, n_unknown.

    Words are cut at ASCII white space and each begins with the blank mark. Null and empty texts have no tokens; repeated
    rows have a row each; an empty table gives an empty result. ``model`` is a path that every executor has.
    """
    path = model or model_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = np.array([count_text(path, t) for t in batch["text"]], dtype=np.int64).reshape(-1, 3)
            yield batch[["id", "no_id"]].assign(n_words=counts[:, 0], n_tokens=counts[:, 1],
                                                n_unknown=counts[:, 2])
        if path in _COUNTS:
            _COUNTS[path].older = {}  # the worker process lives on and may run other work

    rows = df.select(*without_null(id), whole_text(text).alias("text"))
    counted = rows.mapInPandas(run, "id long, no_id boolean, n_words long, n_tokens long, n_unknown long")
    return counted.select(with_null(id), "n_words", "n_tokens", "n_unknown")
