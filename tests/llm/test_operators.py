"""The operators against brute force, on odd and on ordinary rows."""

import gzip
import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import (components, exact_dedup, line_dedup, mixing, neighbours, packing, quality, secrets, simhash,
                            token_counts, warc)
from lumenframe.llm.catalog import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, n string, size string"
BIG = 2 ** 53 + 1


def odd_documents(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, equal ids, and names that operators use inside."""
    long = " ".join(f"wort{i % 977}x" for i in range(30_000))
    lines = "\n".join(" ".join(f"l{i}w{j}" for j in range(30)) for i in range(6))
    key = "Zx9" + "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    rows = [(1, "one two  three four"), (2, "one two\tthree four"), (2, "one two\tthree four"), (None, "one two three four"),
            (3, None), (4, ""), (5, " \n "), (BIG, long), (BIG + 2, long + " end"), (6, lines), (7, "x\n" + lines + "\ny"),
            (8, f'token = "{"0f" * 20}" und AKIA{"A1" * 9} {key} \U0001f600 api_key: short'), (None, None),
            (9, f"{key} {key}"), (10, "ß Σίγμα. 'It's x\x1cy　z <|endoftext|> end"), (11, "a"), (12, "a b")]
    data = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 3}", None, k, "r", None, "q")
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).persist()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (1, None, None), (1, 0, 0)],
                                 "doc_id long, quality int, toxic int")


# --- exact copies

def plain(text):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups(odd, fan_in):
    got = exact_dedup.exact_groups(odd, "doc_id", "text", fan_in).toPandas()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[plain(r["text"])].append(r["doc_id"])
    sizes = Counter({g: len(v) for g, v in groups.items()})
    assert len(got) == odd.count() and got["kept"].sum() == len(groups)
    assert Counter(got["group_size"]) == Counter(n for n in sizes.values() for _ in range(n))
    assert set(got.loc[got["doc_id"] == 2, "keep_id"]) == {1}
    assert got.loc[got["doc_id"] == BIG, "kept"].all()


def test_exact_drop_keeps_columns(odd):
    kept = exact_dedup.drop_copies(odd, "doc_id", "text")
    assert kept.schema == odd.schema
    assert kept.count() == odd.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).distinct().count()


def test_merge_rounds_agree(documents):
    few = exact_dedup.exact_groups(documents, "doc_id", "text", 2).drop("_lf_row_id")
    many = exact_dedup.exact_groups(documents, "doc_id", "text", 64).drop("_lf_row_id")
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0


# --- SimHash

def slow_fingerprint(text):
    import re
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def brute_near(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = slow_components(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[group[i]] = min(doc, least.get(group[i], doc))
    return Counter((doc, f"{prints[i]:016x}", least.get(group[i])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("frame", ["odd", "documents"])
def test_near_groups(frame, request):
    df = request.getfixturevalue(frame)
    got = simhash.near_groups(df, "doc_id", "text").collect()
    want = brute_near([(r["doc_id"], r["text"]) for r in df.collect()])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_keep_one_of_each(odd):
    kept = simhash.keep_one_of_each(odd, "doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert kept.schema == odd.schema and kept.count() < len(rows)
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id = 2").count() == 0


@pytest.mark.parametrize("bucket_rows", [5, 100_000])
def test_links_are_complete(spark, bucket_rows):
    """Random fingerprints, near copies of some, a chain, and a large group around one value."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(4):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    centre = rng.getrandbits(64)
    for _ in range(400):
        q = centre
        for b in rng.sample(range(64), 3):
            q ^= 1 << b
        prints.add(q)
    walk = rng.getrandbits(64)
    for b in range(0, 60, 3):
        walk ^= 0b111 << b
        prints.add(walk)
    prints = sorted(prints)
    rows = [(int(np.array([p], dtype=np.uint64).view(np.int64)[0]), i) for i, p in enumerate(prints)]
    classes = spark.createDataFrame(rows, "fp long, node long").persist()
    edges = simhash.link_fingerprints(classes, 3, bucket_rows)
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    links = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = slow_components(range(len(prints)), links)
    assert {n: got.get(n, n) for n in want} == want


def test_dense_buckets_give_trees():
    fp = np.array([1 << (i % 60) for i in range(500)], dtype=np.uint64)
    pairs = simhash.link_bucket_rows(np.repeat([0, 1], [20, 480]), np.zeros(500, dtype=int), fp, 3)
    assert len(pairs) == 498


@pytest.mark.parametrize("partitions", [1, 2, 3, 4, 5, 8])
def test_thresholds_cover_every_pair(partitions):
    near = [np.array([0.1 * (i + 1), 0.2, 0.3, 0.4]) for i in range(partitions)]
    cost, t = simhash.allot_thresholds([64 // partitions] * partitions, near, 1000, 3)
    assert sum(t) == 3 - partitions + 1 and min(t) >= -1 and cost < float("inf")


def test_block_distances_match_brute_force():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 5, 256).astype(float)
    want = np.zeros(9)
    for u in range(256):
        for v in range(256):
            want[(u ^ v).bit_count()] += h[u] * h[v]
    assert np.allclose(simhash._distances(h, int(h.sum())), want / h.sum() ** 2)


def test_components_of_odd_graphs(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (3, 4), (10, 4), *[(100, i) for i in range(101, 160)],
                                   *[(i, i + 1) for i in range(200, 260)]], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 10: 2} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}
    assert components.components(edges.limit(0)).count() == 0


# --- mixing

def test_mix_meets_targets(odd):
    rows = mixing.mix(odd, "doc_id", "text", "source").toPandas()
    total = rows["size"].sum()
    per = rows.groupby("target").agg(taken=("taken", "sum"), source_size=("source_size", "first"))
    assert rows["taken"].sum() <= 1.5 * total and rows["taken"].sum() > 1.5 * total - 4
    assert ((rows["taken"] <= 2 * rows["size"]) & (rows["taken"] >= 0)).all()
    assert (abs(per["taken"] - per.index) < 1).all() and (per.index <= 2 * per["source_size"]).all()


def test_mixed_rows_hold_the_taken_words(odd):
    taken = mixing.mix(odd, "doc_id", "text", "source").agg(F.sum("taken")).first()[0]
    out = mixing.mixed_rows(odd, "doc_id", "text", "source", "n_chars")
    assert out.columns == odd.columns
    assert out.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == taken


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_cuts_match_row_by_row_sums(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = [(i % 7 if i % 3 else i, s, "w " * (i % 4)) for i in range(60) for s in ("a", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = spark.createDataFrame([(s, len(t.split())) for _, s, t in rows], "source string, size long")
    wanted = []
    for source, total, target in mixing.source_targets(sizes).collect():
        rest, epochs = int(target) % total, int(target) // total
        for _, i, size in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split()))
                                 for i, s, t in rows if s == source):
            wanted.append((i, size, epochs * size + max(0, min(size, rest))))
            rest -= size
    got = mixing.mix(df, "doc_id", "text", "source").select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    words = mixing.mixed_rows(df, "doc_id", "text", "source").select(F.sum(F.regexp_count("text", F.lit("w")))).first()[0]
    assert words == sum(taken for *_, taken in wanted)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    left = 1.5 * 2010 - 20
    assert t["a"] == 20 and abs(t["b"] - left * 2 / 3) < 1e-6 and abs(t[None] - left / 3) < 1e-6
    small = spark.createDataFrame([("a", 10), ("b", 10), (None, 1000)], "source string, size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(small).collect()}
    assert t == {"a": 20, "b": 20, None: 1.5 * 1020 - 40}


# --- packing

def check_packed(rows, docs, path):
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at:at + 4096]
            want[(doc, piece, at, len(own), zlib.crc32(array("I", own).tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), sum(r["length"] for r in rows)


@pytest.mark.parametrize("frame", ["odd", "documents"])
def test_pack(frame, request):
    df = request.getfixturevalue(frame)
    sequences, tokens = check_packed(packing.pack(df, "doc_id", "text").collect(),
                                     [(r["doc_id"], r["text"]) for r in df.collect()], packing.tokenizer_path())
    assert sequences <= -(-tokens // 4096) + max(2, sequences // 50)


def test_words_alone_give_the_tokenizer_s_ids():
    rng = random.Random(1)
    letters = ["a", "B", "é", "É", "́", "ß", "Σ", "İ", "7", "٣", "'", "'s", ".", ",", "!!", "|", "　", " ",
               " ", "\n", "\t", "\x1c", "\x85", "中", "😀", "<|endoftext|>", "<|startoftext|>", "_", "-", "K", "ﬁ", "가", "ᄀ", "ǀ", "ª", "ǅ", "%", "***"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    want = [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert [packing.encode_text(path, t) for t in texts] == want
    known = packing.WordIds(path)
    some = sorted({w for t in texts for w in t.split() if len(w) < 9 and not any(c in w for c in packing.ODD_SPACES)})[:500]
    packing.CACHED_WORDS, size = 20, packing.CACHED_WORDS
    assert [known[w] for w in some * 2] == [packing._ids(path, w) for w in some * 2] and len(known) <= 20
    packing.CACHED_WORDS = size


def test_plan_uses_each_piece_once():
    rng = random.Random(5)
    for _ in range(20):
        counts = Counter(rng.choices(range(1, 101), k=rng.randint(1, 3000)))
        plan = packing.plan_sequences(dict(counts), 100)
        used = Counter()
        for lengths, many in plan:
            assert sum(length * times for length, times in lengths) <= 100
            for length, times in lengths:
                used[length] += times * many
        assert used == counts
    exact = packing.plan_sequences({60: 3, 40: 1, 25: 1, 15: 1, 20: 1, 10: 2}, 100)
    assert sum(many for _, many in exact) == 3


# --- quality

def test_quality_scores(spark, odd, labels):
    rows = quality.score_documents(odd, "doc_id", "text", labels).toPandas()
    assert len(rows) == odd.count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in odd.collect() if r["doc_id"] is not None}
    assert all(held[int(r.doc_id)] == r.held_out for r in rows[rows["doc_id"] < 100].itertuples())


def test_quality_without_labels(odd, labels):
    assert quality.score_documents(odd, "doc_id", "text", labels.limit(0)).filter("score <> 1").count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries()["op1_quality_classifier"](spark, sf)
    known = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.filter("held_out").join(known, "doc_id").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.93
    assert rows.loc[rows["quality"] == 1, "predicted"].mean() > 0.95


def test_monotone():
    x, y = quality.monotone(np.arange(5.0), np.array([0, 0.5, 0.2, 0.9, 0.8]), np.ones(5))
    assert (np.diff(y) >= 0).all() and np.isclose(np.interp(1.5, x, y), 0.35)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(2, quality.STATISTICS))
    model = quality.QualityModel(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    z = model.features(stats)[:, :-1]
    assert abs(z[0] @ z[1] - np.exp(-quality.GAMMA * ((stats[0] - stats[1]) ** 2).sum())) < 0.25


# --- secrets

def slow_spans(text):
    import re
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, e, k in sorted(out)]


@pytest.mark.parametrize("frame", ["odd", "documents"])
def test_base_spans(frame, request):
    import hashlib
    df = request.getfixturevalue(frame)
    got = secrets.scan_secrets(df, "doc_id", "text", "doc_id", "source").collect()
    want = Counter()
    for r in df.collect():
        spans = slow_spans(r["text"])
        kinds = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want[(r["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_shared_values_are_no_credentials(spark):
    key, own = "aB3dE5fG7hJ9kL1mN3pQ5rS7", "Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8"
    rows = [(i, f"x {key} y", f"o{i}") for i in range(4)] + [(9, f"{own} token='{'ab' * 10}'", "o1"), (10, own, "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df, "doc_id", "text", "doc_id", "source").collect()}
    assert got[0]["spans"] == "" and got[9]["n_owned"] == 1 and got[10]["spans"] == "owned:0:24"
    assert got[9]["n_live"] == 3 and got[9]["n_copied"] == 0


@pytest.mark.parametrize("documents", [9, 10])
def test_values_of_one_owner_in_many_documents_are_copied(spark, documents):
    key = "aB3dE5fG7hJ9kL1mN3pQ5rS7"
    rows = [(i, f"x {key} y", "o1") for i in range(documents)] + [(0, f"{key} {key}", "o1")]  # a document twice counts once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan_secrets(df, "doc_id", "text", "doc_id", "source").collect()
    live = documents < 10
    assert {r["n_owned"] > 0 for r in got} == {live} and {r["n_live"] > 0 for r in got} == {live}
    assert secrets.scan_secrets(df, "doc_id", "text", "doc_id", "source", copied_repositories=5).filter("n_owned > 0").count() == 0


# --- token counts

def test_counts_match_the_tokenizer(odd):
    from tokenizers.models import Unigram
    pieces = token_counts.vocabulary(token_counts.model_path())
    model = Unigram([("<unk>", 0.0), *pieces], 0, False)
    path = token_counts.model_path()
    rng = random.Random(4)
    letters = "aeinrstlodu'éñßÀ中中文😀😀0127.,!?-_"
    for _ in range(1500):
        word = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        tokens = model.tokenize("▁" + word)
        assert token_counts.count_text(path, word)[1] == len(tokens), word
    rows = token_counts.count_tokens(odd, "doc_id", "text").collect()
    want = Counter((r["doc_id"], sum(len(model.tokenize("▁" + w.decode())) for w in (r["text"] or "").encode().split()))
                   for r in odd.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == want


def test_ties_keep_the_earlier_start():
    from tokenizers.models import Unigram
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("c", -4.0), ("abc", -6.0)]
    model, counter = Unigram([("<unk>", 0.0), *pieces], 0, False), token_counts.Counter(pieces)
    for word in ("ab", "aba", "abab", "abcab", "xxab", "xaxxb", "babac", "zz", "abcabcabab"):
        assert counter.count(word)[0] == len(model.tokenize(word)), word


# --- lines

def slow_lines(docs, least):
    """(document, line) of the later copies of all maximal runs of ``least`` words: every two equal lines are followed to
    both ends of the run they stand in."""
    lines = [[(i, " ".join(x.split())) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
             for text in docs]
    places, gone = defaultdict(list), set()
    for d, own in enumerate(lines):
        for s, (_, x) in enumerate(own):
            places[x].append((d, s))
    for found in places.values():
        for (d, s), (e, t) in combinations(found, 2):  # the second is the later one
            if s and t and lines[d][s - 1][1] == lines[e][t - 1][1]:
                continue  # the run begins before these
            n = 0
            while s + n < len(lines[d]) and t + n < len(lines[e]) and lines[d][s + n][1] == lines[e][t + n][1]:
                n += 1
            run = lines[e][t:t + n]
            if sum(len(x.split(" ")) for _, x in run) >= least:
                gone |= {(e, i) for i, _ in run}
    return gone


@pytest.mark.parametrize("least", [1, 3, 10])
def test_repeated_runs(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(12)]
    docs = []
    for _ in range(60):
        lines = rng.choices([*pool, "", " \t"], k=rng.randint(0, 12))
        if docs and rng.random() < 0.5 and docs[-1]:
            old = rng.choice(docs).split("\n")
            lines[3:3] = old[1:rng.randint(2, 12)]
        docs.append("\n".join(lines))
    docs.append("\n".join(["same line"] * 40))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = line_dedup.delete_repeats(df, "text", "doc_id", least).collect()
    gone = slow_lines(docs, least)
    for r in got:
        lines = docs[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone)
        assert r["n_deleted"] == sum(1 for d, _ in gone if d == r["doc_id"])


def test_lines_of_odd_documents(odd):
    got = line_dedup.delete_repeats(odd, "text", "doc_id")
    assert got.columns[:len(odd.columns)] == odd.columns and got.count() == odd.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[7]["text"] == "x\ny" and rows[7]["n_deleted"] == 6 and rows[7]["n_runs"] == 1 and rows[6]["n_deleted"] == 0
    assert rows[3]["text"] is None


# --- neighbours

def test_search_reaches_the_true_neighbours(spark):
    vectors = neighbours.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    asked = vectors.filter("id % 50 = 0")
    got = neighbours.search(vectors, asked).toPandas()
    want = neighbours.exact_search(vectors, asked).toPandas()
    hits = len(set(zip(got["query_id"], got["vec_id"])) & set(zip(want["query_id"], want["vec_id"])))
    assert hits / len(want) >= 0.9
    both = got.merge(want, on=["query_id", "vec_id"])
    assert np.allclose(both["score_x"], both["score_y"], rtol=0, atol=0)
    assert (got.groupby("query_id")["rank"].apply(list).map(lambda r: sorted(r) == list(range(1, 11)))).all()


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (100, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = neighbours.usable(df, "vec_id", "embedding")
    got = [tuple(r) for r in neighbours.search(vectors, vectors.filter("id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 2), (0, 4, 100), (100, 1, 2), (100, 2, 0), (100, 3, 1),
                                    (100, 4, 9)]
    assert got[2][3] == 2 ** 0.5
    empty = neighbours.usable(df.limit(0), "vec_id", "embedding")
    assert neighbours.search(empty, empty).count() == 0


# --- archives

def test_archives_round_trip(spark):
    import hashlib
    big = "<p>ü\r\n\r\nWARC/1.1\r\n" * 60_000
    rows = [(1, "u", "x" * 100), (2, None, "x" * 100), (3, "a\r\nb", "short"), (4, "u", "short"), (5, "u", None),
            (None, "u", "y" * 200), (BIG, "u", big), (BIG + 2, "u", big), (2, None, "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.round_trip(df, "page_id", "url", "html").collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        first = {"x" * 100: 1, big: BIG}.get(html)
        again = first is not None and page != first
        want[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want
    assert warc.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_normaliser_reads_whole_streams_once(tmp_path):
    records = [warc.make_record(i, "u", bytes([65 + i]) * (i * 50_000), i * 50_000, "d", None, False) for i in range(8)]
    one = gzip.compress(b"".join(records))
    several = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    for n, data in enumerate((one, several)):
        source, target = tmp_path / f"in{n}.warc.gz", tmp_path / f"out{n}.warc.gz"
        source.write_bytes(data)
        rows = list(warc.normalise_file(str(source), str(target)))
        packed = target.read_bytes()
        assert [zlib.decompress(packed[o:o + size], 31) for o, size, _, _ in rows] == records
        assert (tmp_path / f"out{n}.warc.gz.idx").read_text().splitlines() == ["\t".join(map(str, r)) for r in rows]
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(one[:-300])
    with pytest.raises(ValueError):
        list(warc.normalise_file(str(broken), str(tmp_path / "x.warc.gz")))


# --- all

def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    assert quality.score_documents(none, "doc_id", "text", labels).count() == 0
    assert packing.pack(none, "doc_id", "text").count() == 0
    assert secrets.scan_secrets(none, "doc_id", "text", "doc_id", "source").count() == 0
    assert token_counts.count_tokens(none, "doc_id", "text").count() == 0
    assert line_dedup.delete_repeats(none, "text", "doc_id").count() == 0
    assert exact_dedup.exact_groups(none, "doc_id", "text").count() == 0
    assert simhash.near_groups(none, "doc_id", "text").count() == 0
    assert mixing.mix(none, "doc_id", "text", "source").count() == 0
    assert mixing.mixed_rows(none, "doc_id", "text", "source").count() == 0
