"""op5: later copies of repeated runs are deleted to their last line."""

import random

import pytest

from lumenframe.llm import line_dedup


def slow_whole_runs(docs, least):
    """(document, line) of every line in a run of at least ``least`` words that stands earlier as well, all runs tried."""
    first, gone = {}, set()
    for d, text in enumerate(docs):
        lines = [(i, " ".join(x.split())) for i, x in enumerate(text.split("\n")) if x.strip()]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[s:e])
                if sum(len(x.split(" ")) for x in run) >= least and first.setdefault(run, (d, s)) != (d, s):
                    gone |= {(d, i) for i, _ in lines[s:e]}
    return gone


def check(spark, docs, least):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    gone = slow_whole_runs(docs, least)
    for r in line_dedup.delete_repeats(df, "text", "doc_id", least).collect():
        lines = docs[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone)
        assert r["n_deleted"] == sum(1 for d, _ in gone if d == r["doc_id"])
    return gone


def test_end_of_a_copied_passage_is_deleted(spark):
    def line(word, n):
        return " ".join([word] * n)

    passage = [line("a", 60), line("b", 5), line("c", 5)]
    docs = ["\n".join([line(x, 7), *passage, line(x + x, 9)]) for x in "xyz"]
    assert check(spark, docs, 50) == {(d, i) for d in (1, 2) for i in (1, 2, 3)}


@pytest.mark.parametrize("least", [1, 3, 10, 25])
def test_whole_runs_equal_all_runs(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choices("abc", k=rng.choice([1, 1, 2, 3, 12]))) for _ in range(14)]
    docs = []
    for _ in range(50):
        lines = rng.choices([*pool, "", " \t"], k=rng.randint(0, 12))
        if docs and rng.random() < 0.5:
            lines[3:3] = rng.choice(docs).split("\n")[1:rng.randint(2, 12)]
        docs.append("\n".join(lines))
    docs.append("\n".join(["same line"] * 30))
    assert check(spark, docs, least)
