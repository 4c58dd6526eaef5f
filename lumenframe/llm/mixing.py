"""Mixing of sources to target weights: hash-random order, distributed prefix sums of sizes, an exact cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumenframe.llm.common import ROW, SPACES, column, look_up, packed, whole_text, word_count
from lumenframe.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 10_000
SOURCE = ["no_source", "named"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes``: source, size. Sources by code point, null last, have the weights in turn. Together they get ``share`` of
    all sizes by weight; a target stops at ``most`` times its source's size and the rest goes to the others by weight.
    That ends where the sources in order of (limit / weight) are first not filled; all later ones share what is left.
    The frames here hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
           .withColumn("limit", F.lit(float(most)) * F.col("source_size")))
    everything = Window.partitionBy(F.lit(0))
    full = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = everything.orderBy(*full).rowsBetween(Window.unboundedPreceding, -1)
    after = everything.orderBy(*full).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(everything)
                                  - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.col("rate") < F.col("limit") / F.col("weight")
    first = F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), F.col("rate").alias("rate")))).over(everything)
    per = per.withColumn("final", first["rate"])
    target = F.when(F.col("final").isNull() | (F.col("limit") <= F.col("weight") * F.col("final")), F.col("limit")
                    ).otherwise(F.col("weight") * F.col("final"))
    return per.select("source", "source_size", target.alias("target"))


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source, with the place of its exact cut: no_source, named, rows, source_size, target, epochs, cut,
    alike, over.

    ``sizes``: no_source, named, size, and ``place``, a struct that begins with the uniform ``key``. The leading part of
    the key cuts each source into buckets of at most about ``BUCKET_ROWS`` rows. Their sums carry the prefix sum across
    buckets, so only the one bucket per source that holds the cut is put in order row by row. ``cut`` is the place of the
    row that meets the budget, ``alike`` the number of rows of that place, ``over`` what the budget leaves for them.
    """
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    lead = F.conv(F.substring("place.key", 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
    rows = sizes.withColumn("bucket", F.floor(lead * F.lit(buckets)))
    before = Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    budget = F.floor("target").cast("long")
    per = targets.select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    per = per.join(sums.groupBy(*SOURCE).agg(F.sum("n").alias("rows")), SOURCE)
    per = per.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    starts = sums.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    holding = starts.join(per.select(*SOURCE, "rest"), SOURCE).filter(
        (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("held")))
    places = (rows.join(holding.select(*SOURCE, "bucket", (F.col("rest") - F.col("start")).alias("rest")),
                        [*SOURCE, "bucket"]).groupBy(*SOURCE, "place")
              .agg(F.first("rest").alias("rest"), F.first("size").alias("size"), F.count(F.lit(1)).alias("alike")))
    upto = Window.partitionBy(*SOURCE).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("alike") * F.col("size")
    over = F.col("rest") - F.sum(held).over(upto) + held
    cuts = places.withColumn("over", over).filter((F.col("over") >= 0) & (F.col("over") < held)).select(
        *SOURCE, F.col("place").alias("cut"), "alike", "over")
    return per.drop("rest").join(cuts, SOURCE, "left")


def _with_taken(rows: DataFrame, weights, share: float, most: float) -> DataFrame:
    """Add source_size, target and taken to rows with source, size and place.

    Each row is compared with its source's cut, so rows stay where they are, whatever else they carry; sources with few
    rows move to theirs. Only rows alike in place at a cut are numbered.
    """
    rows = rows.withColumns({"no_source": F.col("source").isNull(), "named": F.coalesce("source", F.lit(""))})
    sizes = materialise(rows.select(*SOURCE, "source", "size", "place"), "sizes")
    cuts = materialise(source_cuts(sizes.drop("source"), source_targets(sizes.select("source", "size"), weights, share,
                                                                       most)), "source-cuts")
    rows = look_up(rows, cuts, SOURCE, "rows")
    at_cut = F.col("cut").isNotNull() & (F.col("place") == F.col("cut"))
    if cuts.filter("alike > 1").limit(1).count():
        number = F.row_number().over(Window.partitionBy(*SOURCE).orderBy("place")) - 1
        rows = (rows.filter(~at_cut).withColumn("number", F.lit(0))
                .unionByName(rows.filter(at_cut).withColumn("number", number)))
    else:
        rows = rows.withColumn("number", F.lit(0))
    once_more = (F.when(at_cut, F.greatest(F.lit(0), F.least(F.col("size"), F.col("over") - F.col("number") * F.col("size"))))
                 .when(F.col("place") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + once_more).cast("long"))


def mix(df: DataFrame, id: str, text: str, source: str, weights=WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """One row per row of ``df``: id, size, source_size, target, taken.

    Size is the number of words. A source's rows are taken in the order of a hash of their id: whole epochs first, then
    rows until the budget is met, the last one in part. Null texts have size 0 and are never taken; null sources are a
    source of their own; rows alike in id and size are interchangeable. An empty table gives an empty result.
    """
    key = F.md5(F.coalesce(column(id).cast("string"), F.lit("")))
    sizes = df.select(column(source).alias("source"), word_count(whole_text(text)).alias("size"),
                      key.alias("key"), column(id).alias("id"))
    sizes = materialise(sizes.select("source", "size", F.struct("key", "id", "size").alias("place")), "row-sizes")
    taken = _with_taken(sizes, weights, share, most)
    return taken.select(F.col("place.id").alias(id), "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, id: str, text: str, source: str, length: str | None = None, weights=WEIGHTS,
               share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row per epoch taken in full, and a row for a part.

    A part holds the first words of its text, joined by single spaces, and ``length`` (if given) its characters.
    """
    body = whole_text(text)
    key = F.md5(F.coalesce(column(id).cast("string"), F.lit("")))
    place = F.struct(key.alias("key"), column(id).alias("id"), word_count(body).alias("size"),
                     F.xxhash64(body).alias("text_hash"))
    rows = df.select(packed(df), column(source).alias("source"), place.alias("place"))
    taken = _with_taken(rows.withColumn("size", F.col("place.size")), weights, share, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") - whole * F.col("size")).otherwise(F.lit(0)).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array()))
    copies = taken.withColumn("words", F.explode(times))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(f"{ROW}.`{text}`"), SPACES), lambda w: w != ""), 1, F.col("words")), " ")
    new = F.when(F.col("words") == 0, F.col(f"{ROW}.`{text}`")).otherwise(cut)
    out = []
    for c in df.columns:
        kind = df.schema[c].dataType
        value = F.col(f"{ROW}.`{c}`")
        if c == text:
            value = new
        elif c == length:
            value = F.when(F.col("words") == 0, value).otherwise(F.length(cut)).cast(kind)
        out.append(value.alias(c))
    return copies.select(*out)
