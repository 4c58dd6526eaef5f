"""Elias-Fano sequences against sorted arrays, and scores against an n-gram model in plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm import lm
from lumenframe.llm.elias_fano import EliasFano, Lists, dump, load
from tests.llm.test_operators import odd_documents


@pytest.mark.parametrize("seed", range(30))
def test_sequences(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 400))
    values = np.sort(rng.integers(0, 1 << int(rng.integers(1, 61)), n))
    if seed % 3 == 0:
        values = np.sort(rng.choice(values, n)) if n else values
    kept = load(b"".join(dump({"s": EliasFano.build(values)})))["s"]
    assert (kept.values(np.arange(n)) == values).all()
    asked = np.r_[values, values + 1, np.maximum(values - 1, 0), rng.integers(0, 1 << 61, 50), 0]
    place, equal = kept.find(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (equal == np.isin(asked, values)).all()


def test_lists():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, int(rng.integers(1, 30)))) for _ in range(200)]
    sizes = np.array([len(x) for x in lists])
    kept = load(b"".join(dump({"l": Lists.build(sizes, np.concatenate(lists))})))["l"]
    starts = np.cumsum(sizes) - sizes
    for k, own in enumerate(lists):
        bounds = kept.bounds(np.full(60, k))
        place, there = kept.find(bounds, np.arange(60))
        assert (there == np.isin(np.arange(60), own)).all()
        assert (place[there] == starts[k] + np.searchsorted(own, np.flatnonzero(there))).all()


def slow_scores(rows, discount=lm.DISCOUNT):
    """(n_tokens, n_known, train tokens, base, score) per row; score of the unquantised model."""
    docs = [(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None],
             zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    learnt = [d for d, held in docs if not held]
    uni = Counter(w for d in learnt for w in d)
    n, v = sum(uni.values()), len(uni)
    two, three = defaultdict(Counter), defaultdict(Counter)
    for d in learnt:
        for i in range(1, len(d)):
            two[d[i - 1]][d[i]] += 1
            three[(d[i - 2] if i > 1 else "start"), d[i - 1]][d[i]] += 1
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)

    def mixed(found, w, lower):
        if not found:
            return lower
        return (max(found[w] - discount, 0) + discount * len(found) * lower) / sum(found.values())
    out = []
    for d, _ in docs:
        score = math.log10(p1(d[0]))
        for i in range(1, len(d)):
            p2 = mixed(two.get(d[i - 1]), d[i], p1(d[i]))
            score += math.log10(mixed(three.get((d[i - 2] if i > 1 else "start", d[i - 1])), d[i], p2))
        out.append((len(d), sum(w in uni for w in d), n, sum(math.log10(p1(w)) for w in d), score))
    return out


def check_scores(df, **options):
    rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    got = sorted(lm.score_documents(df, "doc_id", "text", **options).collect(), key=lambda r: (str(r["doc_id"]), r["score"]))
    want = sorted(zip([i for i, _ in rows], slow_scores(rows)), key=lambda x: (str(x[0]), x[1][4]))
    assert len(got) == len(want)
    for r, (doc, (tokens, known, n, base, score)) in zip(got, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc, tokens, known, n)
        assert r["held_out"] == (zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-12, abs_tol=1e-12)
        assert abs(r["score"] - score) <= 0.004 * tokens
    return got


def test_scores_of_odd_rows(spark):
    check_scores(odd_documents(spark))


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 20_000, "shard_bytes": 15_000, "hot_tokens": 1 << 40}])
def test_scores(spark, options):
    """One shard, and many shards and chunks: without very frequent words the cut doesn't change the model."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = check_scores(df, written=True, **options)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_in_groups_of_frequent_words(spark):
    """Groups change the estimates of frequent words alone: counts and base scores stay, and held-out texts still gain."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r["doc_id"]: r for r in lm.score_documents(df, "doc_id", "text").collect()}
    cut = lm.score_documents(df, "doc_id", "text", chunk_bytes=50_000, shard_bytes=20_000, hot_tokens=100).collect()
    assert len(cut) == len(whole)
    for r in cut:
        w = whole[r["doc_id"]]
        assert r["base_score"] == pytest.approx(w["base_score"], rel=1e-12) and r["n_known"] == w["n_known"]
        assert r["score"] < 0 and abs(r["score"] - w["score"]) < 0.6 * abs(w["score"]) + 2
    held = [r for r in cut if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all words and one unknown word, after a known context, a half-known and an unknown one."""
    texts = ["a b c a b d a b", "b c a", "c c c b a b c", "e"] * 3
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:len(texts)]
    held = [i for i in range(100, 300) if zlib.crc32(str(i).encode()) % 7 == 2]
    ends = ["a", "b", "c", "d", "e", "new"]
    for context in ("a b", "zz b", "zz yy"):
        asked = [f"{context} {w}" for w in ends] + [context]
        rows = list(zip(train, texts)) + list(zip(held, asked)) + list(zip(held[20:], [f"{context} {w} x y" for w in ends]))
        got = {r["doc_id"]: r for r in lm.score_documents(
            spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        start = {i: s for (i, _), s in zip(rows, slow_scores(rows))}
        assert all(abs(got[i]["score"] - start[i][4]) < 0.02 for i in held[:7])
        # the text that ends after the context gives the context's probability times that of the end
        n, v = got[held[0]]["train_tokens"], 6
        prefix = slow_prefix(rows, context.split())
        after = [10 ** (got[held[k]]["score"] - prefix - slow_end(rows, context.split(), w)) for k, w in enumerate(ends)]
        after.append(10 ** (got[held[6]]["score"] - prefix))
        assert sum(after) == pytest.approx(1, abs=0.03) and n > v


def slow_prefix(rows, context):
    """log10 probability of the context's words at the start of a text, from the plain model."""
    return slow_pieces(rows, [w.encode() for w in context])


def slow_end(rows, context, word):
    words = [w.encode() for w in context] + [word.encode()]
    return slow_pieces(rows, [*words, None]) - slow_pieces(rows, words)


def slow_pieces(rows, words):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None] for i, t in rows
            if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for d in docs for w in d)
    n, v, total = sum(uni.values()), len(uni), 0.0
    for i, w in enumerate(words):
        p = (uni[w] + 1) / (n + v + 1)
        for size in (1, 2):
            if i < 1:
                break
            context = (["start"] + words)[i + 1 - size:i + 1]
            if len(context) < size:
                break
            found = Counter(d[j] for d in docs for j in range(1, len(d)) if (["start"] + d)[j + 1 - size:j + 1] == context)
            if found:
                p = (max(found[w] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(found) * p) / sum(found.values())
        total += math.log10(p)
    return total


def test_no_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"), "doc_id", "text")
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect()] == [(0, 0, 0.0, 0.0)] * 3


def test_an_empty_table(spark):
    assert lm.score_documents(odd_documents(spark).limit(0), "doc_id", "text").collect() == []


def test_levels_stay_where_they_are_wanted(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a b c d{i % 3} a b") for i in range(40)], "doc_id long, text string")
    one = sorted(map(tuple, lm.score_documents(df, "doc_id", "text", keep=f"file://{tmp_path}/kept").collect()))
    assert one == sorted(map(tuple, lm.score_documents(df, "doc_id", "text").collect()))
    (trie,) = (tmp_path / "kept").glob("*.trie")
    levels = load(trie.read_bytes())
    words = levels["words"].values(np.arange(levels["words"].n))
    assert (np.diff(words) > 0).all() and levels["nodes"].n == 6 and len(levels["p3"]) == levels["after2"].items.n


def test_folders_without_a_scheme(spark):
    from lumenframe.llm.common import shared_folder
    assert shared_folder(spark, "x").startswith("file:///")


def test_words_of_blocks():
    import random
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["".join(rng.choices("aB c\n\t\x00é😀 ", k=rng.randint(0, 40))).encode() for _ in range(2000)]
    texts += [b"", b"  ", b"x" * 3_000_000 + b" y", b"word " * 600_000, b"", b"A a"]
    there, back, n = {}, {}, 0
    for first, tokens, sizes in lm.batch_tokens(pa.array(texts, pa.binary()).slice(3)):
        for k, own in enumerate(np.split(tokens, np.cumsum(sizes)[:-1])):
            words = texts[3 + first + k].lower().split()
            assert len(own) == len(words) + 1 and own[-1] == lm.END
            for word, h in zip(words, own):
                assert there.setdefault(word, h) == h and back.setdefault(h, word) == word
        n += len(sizes)
    assert n == len(texts) - 3


@pytest.mark.parametrize("hot", [1, 7, 100])
def test_cut_words_have_the_estimates_of_whole_ones(spark, hot):
    """However few tokens a group holds, the scores are those of the plain model: on texts, and on rows where each of a, b and w
    is frequent, where contexts are known to other shards alone, and where texts begin with a frequent word."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    options = {"chunk_bytes": 50_000, "shard_bytes": 20_000, "hot_tokens": hot}
    cut = {r["doc_id"]: r["score"] for r in check_scores(df, written=True, **options)}
    whole = {r["doc_id"]: r["score"] for r in lm.score_documents(df, "doc_id", "text", written=True).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[i] - whole[i]) < 1e-6 * abs(whole[i]) for i in whole)
    rng = np.random.default_rng(hot)
    words = ["a", "b", "c", *(f"w{i}" for i in range(30))]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=[.3, .2, .2] + [.01] * 30))) for i in range(200)]
    rows += [(200 + i, f"a b new{i} a b") for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_scores(made, chunk_bytes=500, shard_bytes=300, hot_tokens=hot)


def test_empty_lists():
    kept = load(b"".join(dump({"l": Lists.build(np.array([0, 2, 0, 0, 1, 0]), np.array([3, 5, 0]))})))["l"]
    for k, own in enumerate([[], [3, 5], [], [], [0], []]):
        assert list(kept.find(kept.bounds(np.full(9, k)), np.arange(9))[1]) == [i in own for i in range(9)]
    none = Lists.build(np.array([0, 0]), np.zeros(0, np.int64))
    assert not none.find(none.bounds(np.array([0, 1])), np.array([0, 0]))[1].any()
