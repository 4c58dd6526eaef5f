"""Repeated runs of lines, found by prefix doubling over line ids. Native: DataFrame functions only.

A document is the sequence of its lines that are not blank. A line's first rank is its place in the sorted order of all
lines. Ranks of runs twice as long come from pairs of ranks, as in building a suffix array: the new rank is the old one
plus the number of suffixes of the same old rank whose second half sorts lower. Suffixes of equal rank are an interval of
the array whose common prefix is at least as long as the run; intervals of one suffix are done and leave the work.

A run counts if it holds at least ``least_words`` words. A line is deleted if it is in a run that counts and stands
earlier as well: these are the later copies of all maximal repeated runs of that size, to their last line. Two kinds of
runs suffice as keys, the shortest that counts from each line on and the shortest that counts up to each line: inside a
maximal run, a line from which enough words follow is in the first kind, and any other is in the second kind that ends
with the run. Neither has more than ``least_words`` lines, so doubling ends at the longest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.llm.common import ROW, ROW_ID, SPACES, WORDS, column, look_up, packed
from lumenframe.session import materialise

LEAST_WORDS = 50
SLICES = 1024


def line_table(rows: DataFrame, least_words: int) -> DataFrame:
    """``rows``: row, id, text. One row per line that is not blank: row, id, seq, line_no, h, need, back.

    ``need`` is the number of lines in the line's shortest run of ``least_words`` words, null if the document ends before.
    ``back`` is the same for the shortest run that ends with the line, null also if that run is its first line's ``need``.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
                     lambda s: s["line"].rlike(WORDS))
    per = rows.select("row", "id", F.posexplode(lines).alias("seq", "s")).select(
        "row", "id", "seq", "s.line_no", F.md5(F.trim(F.regexp_replace("s.line", SPACES, " "))).alias("h"),
        F.regexp_count("s.line", F.lit(WORDS)).cast("long").alias("words"))
    in_order = Window.partitionBy("row").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = per.withColumn("start", F.sum("words").over(in_order) - F.col("words"))
    near = Window.partitionBy("row").orderBy("start").rangeBetween(0, least_words - 1)
    reach = F.max(F.col("start") + F.col("words")).over(near)
    need = F.when(reach - F.col("start") >= least_words, F.count(F.lit(1)).over(near))
    end = F.col("start") + F.col("words")
    behind = Window.partitionBy("row").orderBy(end).rangeBetween(-(least_words - 1), 0)
    back = F.when(F.col("start") - F.min("start").over(behind) >= least_words, F.count(F.lit(1)).over(behind))
    return upto.select("row", "id", "seq", "line_no", "h", need.cast("int").alias("need"), back.cast("int").alias("back"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """row, seq, rank of lines that occur more than once. The rank is the number of such lines that sort lower."""
    groups = materialise(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-groups")
    sliced = groups.withColumn("slice", F.substring("h", 1, 3))
    within = Window.partitionBy("slice").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("slice").agg(F.sum("n").alias("total"))  # at most 4096 rows
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    ranked = sliced.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), "slice")
    ranked = ranked.select("h", "n", (F.col("first") + F.col("inside")).alias("rank"))
    return materialise(look_up(lines.select("row", "seq", "h"), materialise(ranked, "line-ranks"), ["h"], "n")
                       .select("row", "seq", "rank"), "ranks")


def _ordered(pairs: DataFrame, width: Column) -> DataFrame:
    """rank, second, n -> the rank of the pair: the old one plus the suffixes of the same old rank that sort lower.

    Counts are summed by slices of the second rank first, so that a group with very many different seconds is no single
    task's work.
    """
    sliced = pairs.withColumn("slice", F.floor(F.col("second") / width))
    within = Window.partitionBy("rank", "slice").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("rank", "slice").agg(F.sum("n").alias("total")).select(
        "rank", "slice", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("first"))
    return (sliced.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["rank", "slice"])
            .select("rank", "second", "n", (F.col("rank") + F.col("first") + F.col("inside")).alias("new")))


def double(ranks: DataFrame, step: int, positions: int) -> DataFrame:
    """Ranks of runs of ``2 * step`` lines from those of ``step`` lines; runs that occur once leave."""
    second = ranks.select("row", (F.col("seq") - F.lit(step)).alias("seq"), F.col("rank").alias("second"))
    pairs = materialise(ranks.join(second, ["row", "seq"]), "rank-pairs")
    groups = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n"))
    width = F.lit(max(1, -(-positions // SLICES)))
    new = materialise(_ordered(groups, width).filter("n > 1"), "pair-ranks")
    return materialise(look_up(pairs, new, ["rank", "second"], "n").select("row", "seq", F.col("new").alias("rank")),
                       "ranks")


def repeated_lines(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows``: row, id, text. row, line_no and seq of each line that stands in a later copy of a repeated run.

    The order of the corpus is that of id (null last), row and line.
    """
    lines = materialise(line_table(rows, least_words), "lines")
    ranks = first_ranks(lines)
    positions = ranks.count()
    runs = F.array(F.struct("seq", "need"), F.struct((F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("need")))
    wanted = lines.select("row", "id", F.inline(F.filter(runs, lambda r: r["need"].isNotNull())))
    wanted = materialise(wanted.join(ranks, ["row", "seq"]), "wanted-runs")
    longest = wanted.agg(F.max("need")).first()[0] or 0
    keys, step = None, 1
    while step <= longest:
        own = wanted.filter((F.col("need") >= step) & (F.col("need") < 2 * step)).drop("rank")
        tail = ranks.select("row", F.col("seq").alias("tail_seq"), F.col("rank").alias("tail"))
        own = (own.join(ranks, ["row", "seq"]).withColumn("tail_seq", F.col("seq") + F.col("need") - F.lit(step))
               .join(tail, ["row", "tail_seq"]).select("row", "id", "seq", "need", "rank", "tail"))
        keys = own if keys is None else keys.unionByName(own)
        if 2 * step <= longest:
            ranks = double(ranks, step, positions)
        step *= 2
    if keys is None:
        return lines.select("row", "line_no", "seq").limit(0)
    keys = materialise(keys, "run-keys")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "seq")
    key = ["need", "rank", "tail"]
    first = materialise(keys.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1"), "first-runs")
    later = look_up(keys, first, key, "n").filter(
        (F.col("row") != F.col("first.row")) | (F.col("seq") != F.col("first.seq")))
    covered = later.select("row", F.explode(F.sequence("seq", F.col("seq") + F.col("need") - 1)).alias("seq")).distinct()
    return lines.select("row", "seq", "line_no").join(covered, ["row", "seq"])


def delete_repeats(df: DataFrame, text: str, id: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``df`` without the lines of later copies, and n_lines, n_deleted, n_runs.

    Lines are cut at line feeds and compared with white space runs as one space; blank lines belong to no run and stay.
    Null texts stay null and count as one blank line; repeated rows are copies of each other; an empty table gives an
    empty result. If the caller has columns of these names, they are replaced.
    """
    rows = materialise(df.select(packed(df), F.monotonically_increasing_id().alias(ROW_ID)), "line-rows")
    body = F.coalesce(F.col(f"{ROW}.`{text}`"), F.lit(""))
    gone = repeated_lines(rows.select(F.col(ROW_ID).alias("row"), F.col(f"{ROW}.`{id}`").alias("id"), body.alias("text")),
                          least_words)
    per = gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line_no", "seq"))).alias("gone"))
    per = per.select(F.col("row").alias(ROW_ID), F.transform("gone", lambda s: s["line_no"]).alias("gone"), F.expr(
        "size(gone) - size(filter(slice(gone, 2, size(gone)), (s, i) -> s.seq = gone[i].seq + 1))").alias("runs"))
    joined = rows.join(per, ROW_ID, "left")
    lines = F.split(body, "\n")
    marked = F.map_from_arrays("gone", F.transform("gone", lambda i: F.lit(True)))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.map_contains_key(marked, i)), "\n")
    out = []
    for c in df.columns:
        value = F.col(f"{ROW}.`{c}`")
        if c in ("n_lines", "n_deleted", "n_runs"):
            continue
        out.append((F.when(F.col("gone").isNull(), value).otherwise(kept) if c == text else value).alias(c))
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
                         F.coalesce("runs", F.lit(0)).cast("long").alias("n_runs"))
