"""Fill-in-the-middle and source divergence against brute force, on odd and on long rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import divergence, fill_in_middle
from tests.llm.test_operators import odd_documents


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).persist()


# --- fill in the middle

def slow_middle(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_middles(df):
    got = fill_in_middle.transform(df, "doc_id", "text").collect()
    want = [(r["doc_id"], *slow_middle(r["doc_id"], r["text"])) for r in df.collect()]
    assert Counter(map(tuple, got)) == Counter(want)
    back = fill_in_middle.digests(df, "doc_id", "text").collect()
    assert Counter(r["restored_sha256"] for r in back) == Counter(
        hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in df.collect())
    return {r["form"] for r in got}


def test_middles_of_odd_rows(odd):
    check_middles(odd)


def test_middles_of_marks_and_signs(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "<p> is no mark $1 \\2 {3}", "\n\r\n ", "\U0001f600é\x00z", "ab" * 50 + " " * 50,
             "<", "a<P b", "", None]
    rows = [(i * 20 + k, t) for i, t in enumerate(texts) for k in range(20)]
    assert check_middles(spark.createDataFrame(rows, "doc_id long, text string")) == {"plain", "psm", "spm"}


def test_middles_of_long_texts(spark):
    texts = [" ".join(f"w{i}" for i in range(200_000)), "x" * 500_000, "1" * 400_000]
    rows = [(i, t) for i in range(4) for t in texts]
    check_middles(spark.createDataFrame(rows, "doc_id long, text string"))


def test_middles_of_an_empty_table(odd):
    assert fill_in_middle.digests(odd.limit(0), "doc_id", "text").collect() == []


# --- divergence

def slow_audit(rows, least, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t, n in seen[lang].items() if n >= least]
        shares = {}
        for s in {s for x, s in counts if x == lang}:
            n = sum(counts[lang, s][t] for t in kept)
            shares[s] = {t: 1 + 10 ** 9 * (counts[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        whole = sum((counts[k] for k in counts if k[0] == lang), Counter())
        n = sum(whole[t] for t in kept)
        q = {t: 1 + 10 ** 9 * (whole[t] + 2) // (n + 2 * len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        own = shares[source]
        pairs = [(-sum(gap(own[t], shares[s][t]) for t in kept), s) for s in shares if s != source]
        terms = [(-gap(own[t], q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        by = lambda x: (x[0], x[1].encode())
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs, key=by))]
        out += [(lang, source, "term", s, -v, i + 1) for i, (v, s) in enumerate(sorted(terms, key=by)[:top])]
    return out


@pytest.mark.parametrize("least", [1, 2, 10])
def test_audit_of_odd_rows(odd, least):
    got = divergence.audit(odd, "text", "lang", "source", least).collect()
    assert Counter(map(tuple, got)) == Counter(slow_audit([(r["text"], r["lang"], r["source"]) for r in odd.collect()], least))


def test_audit_counts_copies_once_cut(spark):
    """Copies within a source, across sources and across languages; more entries than a task holds at once."""
    text = ["the cat The CAT sat", "ÉTÉ été", "the dog", "", None, "a b c d e f g the"]
    rows = [(text[i % 6], ["en", "fr", None][i % 3], f"s{i % 4}") for i in range(60)] + [(text[0], "en", "s9")] * 30
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("only once", "xx", "c")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 3, 10):
        got = divergence.audit(df, "text", "lang", "source", least, flush=5).collect()
        assert Counter(map(tuple, got)) == Counter(slow_audit(rows, least))


def test_collapsed_rows_keep_multiplicities(odd):
    rows = odd.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    got = divergence.collapsed(rows).collect()
    want = defaultdict(Counter)
    for r in rows.collect():
        want[r["lang"], r["text"]][r["source"]] += 1
    assert {(r["lang"], r["text"]): {w["source"]: w["m"] for w in r["weights"]} for r in got} == want
    assert len(got) == len(want)


def test_audit_of_an_empty_table(odd):
    assert divergence.audit(odd.limit(0), "text", "lang", "source").collect() == []
