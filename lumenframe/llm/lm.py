"""Language-model scores from an Elias-Fano n-gram trie in shards.

The model has order 3. Words of the training rows are counted by slices of their 64-bit hash; a word's number holds its
count on a logarithmic scale (the quantised unigram level) and its place. Every token then travels once, with the two tokens
before it, to the shard of the token before it: there the shard's n-grams are counted, smoothed (interpolated absolute
discounts) and laid down as levels of a trie, one file per shard that the task maps into memory:

- ``words``: the numbers of the shard's words, rising; levels hold places in this one.
- ``nodes``: the words b that are contexts; ``after``: for each b the words that follow it.
- ``before``: for each b the words a that precede it, which are the contexts (a, b); ``after2``: for each (a, b) the words that
  follow, given as their place among the words that follow b, as each follows b too.
- Pointers to the lists rise, and so do the lists, each set above the last; both are Elias-Fano sequences. Probabilities and
  backoff weights are numbers of 16 bits.

A query goes down by successor search relative to the list of its context, and backs off where a search fails. All shards
work on their own tokens alone, and only sums per document travel back.

The tokens after a word b of very many tokens are cut into groups by the word w that follows, by the word a before as well
if w is as frequent, and by document if all three are, so that no shard grows with its words' counts. Counts that such a cut
has parted are summed over all groups before anything is estimated: each shard sends its parts of them to slices by context
and gets the sums back, so the model doesn't depend on the cut. The first token of a text has no context and takes the
unigram probability.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.common import shared_folder, whole_text, with_null, without_null
from lumenframe.llm.elias_fano import EliasFano, Lists, dump, load
from lumenframe.llm.warc import _open
from lumenframe.session import materialise

CHUNK_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
HOT_TOKENS = 1 << 18
BLOCK_BYTES = 1 << 20
DISCOUNT = 0.75
STEP = 1 / 4096  # of a log10 probability or weight in 16 bits
OCTAVE = 64  # steps of the unigram level for a count twice as large
LEVEL_BITS = 44
END = (1 << 63) - 1
RADIX = 0x9E3779B97F4A7C15
PIECE = "shard long, chunk string, data binary"


# Packed arrays -------------------------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: equal bytes of neighbours stand together, and are compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.int64(0))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 62 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(2)).astype(np.int64)


# Texts to words ------------------------------------------------------------------------------------------------

#: Bytes: A-Z as a-z, and one more, so that no byte is zero; ASCII white space is zero.
_FOLD = np.array([0 if b in b" \t\n\x0b\x0c\r" else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint16)


def _powers(n: int, kept: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  grows with the longest word seen
    if len(kept[0]) < n:
        size = max(64, 1 << (n - 1).bit_length())
        kept[0] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, RADIX, np.uint64)])
    return kept[0][:max(n, 1)]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (below END) of all words in a block of texts, and the number of words of each text. ``starts``: where each text
    begins; words end at white space and at the end of their text."""
    folded = _FOLD[data]
    solid = folded > 0
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - begin
    words = np.diff(np.r_[np.searchsorted(begin, starts), len(begin)])
    if not len(begin):
        return np.zeros(0, np.int64), words
    at = np.cumsum(size) - size
    powers = _powers(int(size.max()))
    h = np.add.reduceat(folded[solid].astype(np.uint64) * powers[np.arange(int(size.sum())) - np.repeat(at, size)], at)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.minimum(h >> np.uint64(1), np.uint64(END - 1)).astype(np.int64), words


def _long_text(data: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, a piece at a time; pieces end at white space."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK_BYTES)
        while stop < len(data) and _FOLD[data[stop]] > 0:
            more = np.flatnonzero(_FOLD[data[stop:stop + BLOCK_BYTES]] == 0)
            stop = stop + int(more[0]) if len(more) else min(len(data), stop + BLOCK_BYTES)
        out.append(word_hashes(data[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def batch_tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The tokens of texts (binary, none null), a block of whole texts at a time: (first text, hashes, tokens per text)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if texts.type == pa.binary() else np.int64)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK_BYTES, side="right")) - 1)
        own = data[offsets[k]:offsets[stop]]
        if stop == k + 1:
            hashes = _long_text(own)
            words = np.array([len(hashes)])
        else:
            hashes, words = word_hashes(own, offsets[k:stop] - offsets[k])
        sizes = words + 1
        tokens = np.empty(int(sizes.sum()), dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(tokens), dtype=bool)
        inside[ends] = False
        tokens[ends] = END
        tokens[inside] = hashes
        yield k, tokens, sizes
        k = stop


class _Chunk:
    """Documents of about ``CHUNK_BYTES``: tokens as hashes, and the documents' sizes, ids and flags."""

    def __init__(self, name: str, parts: list[tuple]):
        self.name = name
        self.tokens, self.sizes, self.ids, self.flags = (np.concatenate([p[k] for p in parts]) for k in range(4))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, sorted, and how often each is learnt from. The lowest bit of a sorted key tells held-out tokens."""
        held = np.repeat(self.flags >> 1, self.sizes).astype(np.uint64)
        key = np.sort((self.tokens.astype(np.uint64) << np.uint64(1)) | held)
        word = (key >> np.uint64(1)).astype(np.int64)
        start = _runs(word)
        return word[start], np.add.reduceat((1 - (key & np.uint64(1)).astype(np.int64)), start)

    def coded(self) -> tuple[int, np.ndarray]:
        """The number of words, and each token as a place among the sorted words."""
        codes, words = pd.factorize(self.tokens)
        rank = np.empty(len(words), dtype=np.int32)
        rank[np.argsort(words)] = np.arange(len(words), dtype=np.int32)
        return len(words), rank[codes]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Chunk]:
    """Chunks of a task's rows (id, no_id, held, text as bytes). The same rows in the same order give the same chunks."""
    parts, size, k = [], 0, 0
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        none, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("no_id", "held"))
        flags = (none.astype(np.uint8) + 2 * held.astype(np.uint8)).astype(np.uint8)
        for first, tokens, sizes in batch_tokens(batch.column("text")):
            own = slice(first, first + len(sizes))
            parts.append((tokens, sizes, ids[own].astype(np.int64), flags[own]))
            size += len(tokens)
            if size * 6 >= most:
                yield _Chunk(f"{part}-{k}", parts)
                parts, size, k = [], 0, k + 1
    if parts:
        yield _Chunk(f"{part}-{k}", parts)


def _cut_points(shards: int) -> np.ndarray:
    return np.arange(1, shards, dtype=np.int64) * (END // shards)


def _ask(most: int, shards: int):
    """Each chunk's words and their training counts, by slices of the hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most):
            words, counts = chunk.counted()
            cuts = np.r_[0, np.searchsorted(words, _cut_points(shards)), len(words)]
            rows = [(s, chunk.name, pack(gaps(words[a:b]), counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "chunk", "data"), r)) for r in rows])
    return run


def _codes(most: int):
    """Each chunk's documents and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most):
            n, codes = chunk.coded()
            yield pa.RecordBatch.from_pylist([{"chunk": chunk.name, "n_words": n,
                                               "docs": pack(chunk.ids, chunk.sizes, chunk.flags), "codes": pack(codes)}])
    return run


# Unigrams ------------------------------------------------------------------------------------------------------

def _levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.rint(OCTAVE * np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def _answer(shards: int, hot: int):
    """The words of a slice: their counts over all chunks and their numbers, for each chunk that asked."""
    def run(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d, "i8", "i8") for d in frames["data"]]
        words, codes = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        counts = np.zeros(len(words), dtype=np.int64)
        np.add.at(counts, codes, np.concatenate([p[1] for p in parts]))
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        numbers = (_levels(counts) << LEVEL_BITS) | (place * shards + key[0] + 1)
        ends = np.cumsum([len(p[0]) for p in parts])
        data = [pack(numbers[codes[e - len(p[0]):e]], counts[codes[e - len(p[0]):e]]) for e, p in zip(ends, parts)]
        none = [0] * (len(parts) - 1)
        return pd.DataFrame({"shard": key[0], "chunk": frames["chunk"].to_numpy(), "data": data,
                             "tokens": [int(counts.sum())] + none, "kinds": [int((counts > 0).sum())] + none,
                             "groups": [int(_groups(numbers, hot).max())] + [1] * len(none)})
    return run


def unigram(numbers: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """Probability of words by the level in their number: add one, with one unknown word."""
    level = numbers >> LEVEL_BITS
    return (np.where(level > 0, np.exp2((level - 1) / OCTAVE), 0.0) + 1.0) / (tokens + kinds + 1)


# Tokens to shards ----------------------------------------------------------------------------------------------

def _groups(numbers: np.ndarray, hot: int, starts: int = 0) -> np.ndarray:
    """Into how many groups tokens are cut for a word's sake, by the level in its number. Number 0 is the start of a text,
    which is seen ``starts`` times."""
    level = numbers >> LEVEL_BITS
    count = np.where(level > 0, np.exp2((np.maximum(level, 1) - 1) / OCTAVE), 0.0).astype(np.int64)
    return 1 + np.where(numbers == 0, starts, count) // hot


def _spread(a: np.ndarray, b: np.ndarray, w: np.ndarray, doc: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray],
            shards: int) -> np.ndarray:
    """Shard of each token w with the words a, b before it; ``groups`` of a, b and w."""
    of_a, of_b, of_w = groups
    first = np.where(of_b > 1, _mix(w) % of_b, 0)
    few = np.minimum(of_b, of_w)
    second = np.where(few > 1, _mix(a + 1) % few, 0)
    few = np.minimum(few, of_a)
    third = np.where(few > 1, _mix(doc + 1) % few, 0)
    return _mix(_mix(b) + first * 0x9E3779B1 + second * 0x85EBCA6B + third * 0xC2B2AE35) % shards


def _send(tokens: int, kinds: int, hot: int, texts: int, shards: int):
    """Chunks with the answers of all slices -> base scores (in shard rows of their own) and tokens by shard."""
    def one(chunk: str, n_words: int, docs: bytes, codes: bytes, answers: list) -> Iterator[tuple]:
        parts = [unpack(r["data"], "i8", "i8") for r in sorted(answers, key=lambda r: r["shard"])]
        numbers, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
        if len(numbers) != n_words:
            raise RuntimeError("the rows came in another order when read again; pass a written table")
        ids, sizes, flags = unpack(docs, "i8", "i8", "u1")
        codes = unpack(codes, "i4")[0]
        starts = np.cumsum(sizes) - sizes
        count = counts[codes]
        base = np.add.reduceat(np.log10((counts + 1.0) / (tokens + kinds + 1))[codes], starts)
        known = np.add.reduceat((count > 0).astype(np.int64), starts)
        first = np.log10(unigram(numbers[codes[starts]], tokens, kinds))
        yield (shards + zlib.crc32(chunk.encode()) % shards, chunk,
               pack(ids, sizes, known, base, first, flags))
        del base, known, count
        order = np.argsort(numbers)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        sorted_numbers = np.r_[0, numbers[order]]  # 0: before the text
        groups = _groups(sorted_numbers, hot, texts)
        token = rank[codes]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.ones(len(token), dtype=bool)
        inner[starts] = False
        w = token[inner]
        b = token[:-1][inner[1:]]
        second = np.zeros(len(token), dtype=bool)
        second[starts[sizes > 1] + 1] = True
        a = np.r_[0, 0, token[:-2]][:len(token)]
        a = np.where(second, 0, a)[inner]
        doc = doc[inner]
        shard = _spread(sorted_numbers[a], sorted_numbers[b], sorted_numbers[w], ids[doc], (groups[a], groups[b], groups[w]), shards)
        n = len(order) + 1
        if n < 1 << 21:
            by = np.argsort((b * n + a) * n + w, kind="stable")
        else:
            by = np.lexsort((w, a, b))
        by = by[np.argsort(shard[by], kind="stable")]
        shard, b, a, w = shard[by], sorted_numbers[b[by]], sorted_numbers[a[by]], sorted_numbers[w[by]]
        mark = (doc[by] * 2 + (flags[doc[by]] >> 1)).astype(np.int32)  # odd: held out
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(shard)]):
            yield int(shard[lo]), chunk, pack(gaps(b[lo:hi]), gaps(a[lo:hi]), w[lo:hi], mark[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                found = list(one(r["chunk"], r["n_words"], r["docs"], r["codes"], r["answers"]))
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "chunk", "data"), x)) for x in found])
    return run


# Shards --------------------------------------------------------------------------------------------------------

def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) / STEP), 65_535).astype(np.uint16)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new tuple begins in sorted columns."""
    new = np.zeros(len(sorted_columns[0]), dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[starts, n])


class Grams:
    """Counted n-grams (a, b, w), sorted by b, a, w as places among ``n`` words; their pairs (b, w), nodes b and contexts
    (a, b) with total and number of kinds. An n-gram of count zero is there to be asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, count: np.ndarray, n: int):
        self.a, self.b, self.w, self.count = a, b, w, count
        by = np.argsort(b * np.int64(max(n, 1)) + w, kind="stable")
        start = _runs(b[by], w[by])
        self.pair_b, self.pair_w, self.pair_n = b[by[start]], w[by[start]], _sums(count[by], start)
        self.pair_of = np.empty(len(b), dtype=np.int64)
        self.pair_of[by] = np.repeat(np.arange(len(start)), _sizes(start, len(b)))
        self.node, self.context = _runs(self.pair_b), _runs(b, a)
        self.total, self.kinds = _sums(self.pair_n, self.node), _sums(self.pair_n > 0, self.node)
        self.total2, self.kinds2 = _sums(count, self.context), _sums(count > 0, self.context)

    def parted(self, hot_a: np.ndarray, hot_b: np.ndarray, hot_w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes, pairs, contexts and n-grams of which other shards may hold a part, by what is known of each word."""
        return (np.flatnonzero(hot_b[self.pair_b[self.node]]), np.flatnonzero(hot_b[self.pair_b] & hot_w[self.pair_w]),
                np.flatnonzero(hot_b[self.b[self.context]]), np.flatnonzero(hot_b[self.b] & hot_w[self.w] & hot_a[self.a]))

    def parts(self, words: np.ndarray, parted: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """What this shard knows of them: b, a (-1 for nodes and pairs), w (0 for nodes and contexts), counts and kinds. Counts
        of nodes and contexts leave out those that stand there for themselves."""
        nodes, pairs, contexts, grams = parted
        rest, rest2 = self.pair_n.copy(), self.count.copy()
        rest[pairs], rest2[grams] = 0, 0
        none = [np.zeros(len(x), dtype=np.int64) for x in parted]
        b = [words[self.pair_b[self.node[nodes]]], words[self.pair_b[pairs]], words[self.b[self.context[contexts]]], words[self.b[grams]]]
        a = [none[0] - 1, none[1] - 1, words[self.a[self.context[contexts]]], words[self.a[grams]]]
        w = [none[0], words[self.pair_w[pairs]], none[2], words[self.w[grams]]]
        count = [_sums(rest, self.node)[nodes], self.pair_n[pairs], _sums(rest2, self.context)[contexts], self.count[grams]]
        kinds = [_sums(rest > 0, self.node)[nodes], none[1], _sums(rest2 > 0, self.context)[contexts], none[3]]
        return [np.concatenate(x) for x in (b, a, w, count, kinds)]

    def put(self, parted: tuple[np.ndarray, ...], count: np.ndarray, kinds: np.ndarray) -> None:
        """Takes over the sums of all shards, in the order of ``parts``."""
        nodes, pairs, contexts, grams = parted
        ends = np.cumsum([len(x) for x in parted])
        self.total[nodes], self.pair_n[pairs], self.total2[contexts], self.count[grams] = np.split(count, ends[:-1])
        self.kinds[nodes], _, self.kinds2[contexts], _ = np.split(kinds, ends[:-1])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)


def build_levels(words: np.ndarray, grams: Grams, lower: np.ndarray, discount: float = DISCOUNT) -> dict:
    """Levels of what has been seen: nodes, pairs, contexts and n-grams with counts above zero, as places in those of ``words``
    that occur in them. ``lower``: unigram probability of each of ``words``."""
    g, length = grams, len(words)
    pairs, triples = np.flatnonzero(g.pair_n), np.flatnonzero(g.count)
    nodes, contexts = np.flatnonzero(g.total), np.flatnonzero(g.total2)
    node_b, context_b, context_a = g.pair_b[g.node[nodes]], g.b[g.context[contexts]], g.a[g.context[contexts]]
    used = np.zeros(length, dtype=bool)
    for x in (node_b, context_a, g.pair_w[pairs]):
        used[x] = True
    place = np.cumsum(used) - 1
    at = np.repeat(np.arange(len(g.node)), _sizes(g.node, len(g.pair_b)))[pairs]  # the node of each pair
    weight = discount * g.kinds / np.maximum(g.total, 1)
    p2 = (g.pair_n[pairs] - discount) / g.total[at] + weight[at] * lower[g.pair_w[pairs]]
    rank = np.cumsum(g.pair_n > 0) - 1
    pair_of = rank[g.pair_of[triples]]
    at2 = np.repeat(np.arange(len(g.context)), _sizes(g.context, len(g.b)))[triples]  # the context of each n-gram
    weight2 = discount * g.kinds2 / np.maximum(g.total2, 1)
    p3 = (g.count[triples] - discount) / g.total2[at2] + weight2[at2] * p2[pair_of]
    size, size2 = np.bincount(at, minlength=len(g.node))[nodes], np.bincount(at2, minlength=len(g.context))[contexts]
    first = (np.cumsum(size) - size)[np.searchsorted(node_b, g.b[triples])]  # of the list of b, for each n-gram
    children = np.bincount(np.searchsorted(node_b, context_b), minlength=len(nodes))
    return {"words": EliasFano.build(words[used]), "nodes": EliasFano.build(place[node_b]),
            "after": Lists.build(size, place[g.pair_w[pairs]]), "before": Lists.build(children, place[context_a]),
            "after2": Lists.build(size2, pair_of - first),
            "p2": quantised(p2), "p3": quantised(p3), "back": quantised(weight[nodes]), "back2": quantised(weight2[contexts])}


def query(levels: dict, words: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 probability of w after (a, b), given as places in ``words`` (numbers of words) and sorted by b, a. ``lower``:
    log10 unigram probability of each of ``words``. Searches of one word and of one context are made once."""
    score = lower[w]
    place, known = levels["words"].find(words)
    starts = _runs(b)
    node, found = levels["nodes"].find(place[b[starts]])
    found &= known[b[starts]]
    size = _sizes(starts, len(b))
    i = np.flatnonzero(np.repeat(found, size))  # tokens whose b is a context
    if not len(i):
        return score
    of = np.repeat(np.flatnonzero(found), size[found])
    order = np.cumsum(found) - 1
    bounds = levels["after"].bounds(node[found])
    own = order[of]
    pair, hit = levels["after"].find(tuple(x[own] for x in bounds), place[w[i]])
    hit &= known[w[i]]
    score[i] = np.where(hit, 0.0, score[i] - levels["back"][node[of]] * STEP)
    score[i[hit]] = -(levels["p2"][pair[hit]] * STEP)
    starts2 = _runs(b[i], a[i])  # of i
    size2 = _sizes(starts2, len(i))
    head, word = node[of[starts2]], a[i[starts2]]
    context, full = levels["before"].find(levels["before"].bounds(head), place[word])
    full &= known[word]
    j = np.flatnonzero(np.repeat(full, size2))  # of i: those whose (a, b) is a context
    if not len(j):
        return score
    of2 = np.repeat(np.cumsum(full) - 1, size2)[j]
    context = context[full]
    bounds2 = levels["after2"].bounds(context)
    triple, hit2 = levels["after2"].find(tuple(x[of2] for x in bounds2), pair[j] - bounds[0][own[j]])
    hit2 &= hit[j]
    at = i[j]
    score[at] -= levels["back2"][context[of2]] * STEP
    score[at[hit2]] = -(levels["p3"][triple[hit2]] * STEP)
    return score


def store(path: str, pieces: list[bytes]) -> None:
    files, place = _open(path)
    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(place, compression=None) as out:
        for piece in pieces:
            out.write(piece)


def remove(path: str) -> None:
    files, place = _open(path)
    files.delete_file(place)


def map_file(path: str) -> mmap.mmap:
    """The file in memory by mapping; one that no local path leads to is mapped from a copy that has no name any more."""
    files, place = _open(path)
    if isinstance(files, fs.LocalFileSystem):
        with open(place, "rb") as file:
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as copy, files.open_input_stream(place) as source:
        while piece := source.read(1 << 22):
            copy.write(piece)
        copy.flush()
        return mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)


def _counted(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, Grams, np.ndarray, np.ndarray]:
    """All tokens (b, a, w, mark) of a shard: its words' numbers, rising; the n-grams with their training counts; the order of
    the tokens by n-gram, and the tokens of each."""
    n = sum(len(p[0]) for p in parts)
    b, a, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
    runs = [_runs(b), _runs(b, a), np.arange(n)]  # within a chunk, b and a come in runs
    codes, words = pd.factorize(np.concatenate([x[r] for x, r in zip((b, a, w), runs)]))
    order = np.argsort(words)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    words, codes = words[order], np.split(rank[codes], np.cumsum([len(r) for r in runs[:2]]))
    b, a = (np.repeat(c, _sizes(r, n)) for c, r in zip(codes, runs[:2]))
    w = codes[2]
    del codes
    if len(words) < 1 << 21:
        by = np.argsort((b * len(words) + a) * len(words) + w, kind="stable")
    else:
        by = np.lexsort((w, a, b))
    a, b, w = a[by], b[by], w[by]
    start = _runs(b, a, w)
    learnt = np.concatenate([p[3] for p in parts])[by] & 1 == 0
    return words, Grams(a[start], b[start], w[start], _sums(learnt, start), len(words)), by, _sizes(start, n)


def _tokens(data: bytes) -> list[np.ndarray]:
    b, a, w, mark = unpack(data, "i8", "i8", "i8", "i4")
    return [np.cumsum(b), np.cumsum(a), w, mark]


def _hot(words: np.ndarray, hot: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are cut for: as a, as b, as w."""
    cut = _groups(words, hot, starts) > 1
    return cut, cut, cut


def _slice_of(b: np.ndarray, a: np.ndarray, slices: int) -> np.ndarray:
    return _mix(_mix(b) + a) % slices


def _ask_sums(hot: int, starts: int, shards: int, slices: int):
    """A shard's parts of counts that the cut of frequent words has spread over shards, by slices of their contexts."""
    def run(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if key[0] < shards:
            parts = []
            for data in frames["data"]:
                part = _tokens(data)
                runs = _runs(part[0])
                cut = np.repeat(_groups(part[0][runs], hot, starts) > 1, _sizes(runs, len(part[0])))
                if cut.any():
                    parts.append([x[cut] for x in part])
            if parts:
                words, grams, _, _ = _counted(parts)
                del parts
                found = grams.parts(words, grams.parted(*_hot(words, hot, starts)))
                of = _slice_of(found[0], found[1], slices)
                by = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
                for x in np.split(by, cuts[1:]):
                    b, a, w, count, kinds = (f[x] for f in found)
                    rows.append((key[0], int(of[x[0]]), pack(gaps(b), gaps(a), w, count, kinds)))
        return pd.DataFrame(rows, columns=["shard", "slice", "data"])
    return run


def _sum_parts(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
    """The sums of a slice for each shard that sent parts, in their order."""
    parts = [unpack(d, "i8", "i8", "i8", "i8", "i8") for d in frames["data"]]
    b, a, w, count, kinds = (np.concatenate([np.cumsum(p[k]) if k < 2 else p[k] for p in parts]) for k in range(5))
    by = np.lexsort((w, a, b))
    b, a, w = b[by], a[by], w[by]
    start, context = _runs(b, a, w), _runs(b, a)
    total, more = _sums(count[by], start), _sums(kinds[by], start)
    more[(w[start] > 0) & (total > 0)] = 1
    of = np.searchsorted(start, context)  # contexts begin with their own row, which every shard sends
    whole, every = _sums(total, of), _sums(more, of)
    total[of], more[of] = whole, every
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.repeat(np.arange(len(start)), _sizes(start, len(by)))
    ends = np.cumsum([len(p[0]) for p in parts])
    data = [pack(total[place[e - len(p[0]):e]], more[place[e - len(p[0]):e]]) for e, p in zip(ends, parts)]
    return pd.DataFrame({"shard": frames["shard"].to_numpy(), "slice": key[0], "data": data})


def _score(folder: str, keep: bool, tokens: int, kinds: int, hot: int, starts: int, shards: int, slices: int, discount: float):
    """A shard's tokens: build its levels from the training ones, score all, and send sums per document back. ``sums``: of the
    counts that it holds a part of, by slice. A file that is not kept goes once it is mapped."""
    def run(key: tuple, frames: pd.DataFrame, sums: pd.DataFrame | None = None) -> pd.DataFrame:
        if key[0] >= shards:
            return frames[["shard", "chunk", "data"]]
        parts = [_tokens(d) for d in frames["data"]]
        sizes = np.array([len(p[0]) for p in parts])
        n = int(sizes.sum())
        words, grams, by, size = _counted(parts)
        mark = [p[3] for p in parts]
        most = np.array([int(m.max() >> 1) + 1 for m in mark])
        mark = np.concatenate(mark)
        del parts
        if sums is not None and len(sums):
            parted = grams.parted(*_hot(words, hot, starts))
            asked = grams.parts(words, parted)[:2]
            back = np.argsort(_slice_of(*asked, slices), kind="stable")
            told = [unpack(d, "i8", "i8") for d in sums.sort_values("slice")["data"]]
            whole = np.empty((2, len(back)), dtype=np.int64)
            whole[:, back] = np.concatenate(told, axis=1)
            grams.put(parted, *whole)
        lower = unigram(words, tokens, kinds)
        levels = build_levels(words, grams, lower, discount)
        a, b, w = grams.a, grams.b, grams.w
        del grams
        path = f"{folder}/shard-{key[0]:06d}-{uuid.uuid4().hex}.trie"  # a task that runs again has a file of its own
        store(path, dump(levels))
        del levels
        mapped = map_file(path)
        if not keep:
            remove(path)
        score = query(load(mapped), words, a, b, w, np.log10(lower))
        first = np.cumsum(most) - most
        doc = (np.repeat(first, sizes) + (mark >> 1))[by]
        docs, of = (np.arange(int(most.sum())), doc) if most.sum() <= 8 * n else np.unique(doc, return_inverse=True)
        sums = np.bincount(of, weights=np.repeat(score, size), minlength=len(docs))
        held = np.flatnonzero(np.bincount(of, minlength=len(docs)))
        docs, sums = docs[held], sums[held]
        cuts = np.searchsorted(docs, np.r_[first, first[-1] + most[-1]])
        data = [pack((docs[x:y] - f).astype(np.int32), sums[x:y]) for x, y, f in zip(cuts[:-1], cuts[1:], first)]
        return pd.DataFrame({"shard": key[0], "chunk": frames["chunk"].to_numpy(), "data": data})
    return run


def _finish(shards: int):
    """All sums of a chunk's documents, in the order of shards, on top of the first token's."""
    def run(frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("shard")
        ids, sizes, known, base, first, flags = unpack(frames["data"].iloc[-1], "i8", "i8", "i8", "f8", "f8", "u1")
        score = first.copy()
        for data in frames["data"].iloc[:-1]:
            docs, sums = unpack(data, "i4", "f8")
            score[docs] += sums
        return pd.DataFrame({"id": ids, "no_id": (flags & 1).astype(bool), "held_out": flags >= 2, "n_tokens": sizes,
                             "n_known": known, "base_score": base, "score": score})
    return run


def score_documents(df: DataFrame, id: str, text: str, written: bool = False, held_out: int = 2, folds: int = 7,
                    chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, hot_tokens: int = HOT_TOKENS,
                    discount: float = DISCOUNT, keep: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words (A-Z as a-z, cut at ASCII white space) and one end. Rows whose crc32(id as text) modulo
    ``folds`` is ``held_out`` are scored but not learnt from. Null texts are empty and have the end alone; a null id is hashed
    as empty text; repeated rows are learnt from as often as they stand there, and score alike; other columns play no part; an
    empty table gives an empty result, and without training rows every token has probability one over one word.

    ``df`` is read twice and must then give its rows in the same order: set ``written`` for a table read from files, others
    are written first. Words are told apart by 63 bits of their hash. ``keep`` is a shared folder in which the tries stay; without
    it a shard's file goes when the shard has been scored.
    """
    spark = df.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("`" + id.replace("`", "``") + "`").cast("string"), F.lit("")).cast("binary")),
                  F.lit(folds))
    rows = df.select(*without_null(id), (fold == held_out).alias("held"), whole_text(text).cast("binary").alias("text"))
    if not written:
        rows = materialise(rows, "lm-rows")
    size, starts = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held"))).first())
    shards = max(1, -(-size // shard_bytes))
    slices = max(1, shards // 4)
    answers = materialise(
        rows.mapInArrow(_ask(chunk_bytes, slices), PIECE).groupBy("shard")
        .applyInPandas(_answer(slices, hot_tokens), PIECE + ", tokens long, kinds long, groups long"), "lm-words")
    found = answers.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"), F.max("groups").alias("groups")).first()
    tokens, kinds = found["tokens"] or 0, found["kinds"] or 0
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))
    chunks = rows.mapInArrow(_codes(chunk_bytes), "chunk string, n_words long, docs binary, codes binary")
    pieces = (chunks.join(answers, "chunk").mapInArrow(_send(tokens, kinds, hot_tokens, starts, shards), PIECE)
              .repartition("shard"))  # read twice where a word is cut
    score = _score(keep or shared_folder(spark, "lm-trie"), keep is not None, tokens, kinds, hot_tokens, starts, shards, slices,
                   discount)
    if (found["groups"] or 1) > 1:
        parts = pieces.groupBy("shard").applyInPandas(_ask_sums(hot_tokens, starts, shards, slices),
                                                      "shard long, slice long, data binary")
        told = parts.groupBy("slice").applyInPandas(_sum_parts, "shard long, slice long, data binary")
        sums = pieces.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(
            lambda key, frames, sums: score(key, frames, sums), PIECE)
    else:
        sums = pieces.groupBy("shard").applyInPandas(lambda key, frames: score(key, frames), PIECE)
    scored = sums.groupBy("chunk").applyInPandas(
        _finish(shards), "id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(with_null(id), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
