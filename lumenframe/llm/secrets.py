"""Secrets in texts, told apart by how many owners share them. Native: DataFrame functions only.

Three fixed kinds of pattern give the base spans. A fourth, wider kind (long mixed runs of credential characters) is only
a candidate: it becomes a span if its value looks live. Values that several owners share, or that stand in many
repositories of whatever owners, are examples that were copied; a value of a single owner in few repositories looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.llm.common import column, look_up, whole_text
from lumenframe.session import materialise

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OWNED = r"[A-Za-z0-9+/_-]{24,}"
#: Kinds in the order in which spans of the same start are listed. A run that is too short never holds one that is long
#: enough for ACCESS, HEX and OWNED, so their least length stands in the pattern; ASSIGN is filtered afterwards.
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (ASSIGN, ACCESS, HEX, OWNED)
LEAST_VALUE = 12
LEAST_DISTINCT = 10
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 10


def _found(text: Column, pattern: str) -> Column:
    """Matches of a text from left to right, each with the number of characters between it and the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(matches) > 0, F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)),
        lambda m, g: F.struct(m.alias("match"), F.length(g).cast("long").alias("gap"))))


def _live_looking(value: Column) -> Column:
    """Upper and lower case and digits, and enough different characters."""
    return (value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT))


def candidates(rows: DataFrame) -> DataFrame:
    """``rows``: row, repository, owner, found_0 to found_3. One row per match that counts: row, kind (number), start,
    end, value, and the row's repository and owner. Positions are code points; end is exclusive."""
    parts = []
    for k in range(len(KINDS)):
        one = rows.filter(F.col(f"found_{k}").isNotNull()).select(
            "row", "repository", "owner", F.lit(k).alias("kind"), F.posexplode(f"found_{k}").alias("i", "m"))
        parts.append(one)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = F.length("m.match").cast("long")
    placed = every.withColumn("end", F.sum(F.col("m.gap") + long).over(before))
    value = F.when(F.col("kind") == 0, F.regexp_extract("m.match", ASSIGN, 2)).otherwise(F.col("m.match"))
    placed = placed.select("row", "repository", "owner", "kind", (F.col("end") - long).alias("start"), "end",
                           value.alias("value"))
    return placed.filter(F.when(F.col("kind") == 0, F.length("value") >= LEAST_VALUE)
                         .when(F.col("kind") == 3, _live_looking(F.col("value"))).otherwise(F.lit(True)))


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ownership(found: DataFrame) -> DataFrame:
    """One row per value hash: rows_held, repositories and owners that are distinct. Summed step by step, so that a
    value held by many rows is never gathered."""
    held = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"),
                                        F.sum("n").alias("rows_held"))


def scan_secrets(df: DataFrame, id: str, text: str, repository: str, owner: str,
                 copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """One row per row of ``df``: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied.

    spans lists kind:start:end by start, then kind. base_sha256 is that of the base kinds' list alone; without any it is
    the digest of the empty text. n_live counts spans whose value a single owner has in fewer than ``copied_repositories``
    repositories, n_copied those that at least ``copied_owners`` owners share or that many repositories hold. Null texts are empty; a null repository or owner is one of its own; repeated rows
    have a row each. An empty table gives an empty result.
    """
    body = whole_text(text)
    rows = df.select(F.monotonically_increasing_id().alias("row"), column(id).alias("id"),
                     column(repository).cast("string").alias("repository"), column(owner).cast("string").alias("owner"),
                     *[_found(body, p).alias(f"found_{k}") for k, p in enumerate(PATTERNS)])
    rows = materialise(rows, "secret-matches")
    found = candidates(rows).withColumn("hash", F.xxhash64("value", F.md5("value")))
    found = materialise(found.select("row", "kind", "start", "end", "hash", "repository", "owner"), "secret-candidates")
    shared = materialise(ownership(found), "secret-owners")
    rated = look_up(found.select("row", "kind", "start", "end", "hash"), shared, ["hash"], "rows_held")
    many = F.col("repositories") >= copied_repositories
    rated = rated.withColumns({"live": (F.col("owners") == 1) & ~many, "copied": (F.col("owners") >= copied_owners) | many})
    counts = rated.filter((F.col("kind") < 3) | F.col("live"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("text"), "live", "copied")
    per = counts.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    added = F.filter("all", lambda s: (s["kind"] == 3) & ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    per = per.select("row", base.alias("base"), added.alias("added"))
    listed = F.sort_array(F.concat("base", "added"))
    per = per.select(
        "row", *[_of_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(F.array_join(F.transform("base", lambda s: s["text"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(listed, lambda s: s["text"]), ",").alias("spans"),
        F.size("added").cast("long").alias("n_owned"),
        F.size(F.filter(listed, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(listed, lambda s: s["copied"])).cast("long").alias("n_copied"))
    none = F.lit(0).cast("long")
    full = rows.select("row", "id").join(per, "row", "left")
    numbers = ["n_assign", "n_access", "n_hex"]
    return full.select(F.col("id").alias(id), *[F.coalesce(c, none).alias(c) for c in numbers],
                       F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                       F.coalesce("spans", F.lit("")).alias("spans"),
                       *[F.coalesce(c, none).alias(c) for c in ("n_owned", "n_live", "n_copied")])
