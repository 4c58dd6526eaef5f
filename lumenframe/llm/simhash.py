"""SimHash near-duplicates found by the generalised pigeonhole principle.

Bits that go together are grouped, the 64 bits are cut into partitions, and partition i gets a threshold t_i >= -1
with sum(t_i) = most - partitions + 1. Two fingerprints at most ``most`` bits apart then differ in at most t_i bits of
some partition i. Thresholds are allotted by dynamic programming on estimated numbers of candidates. Fingerprints are
probed partition by partition and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.common import (ROW, ROW_ID, look_up, packed, task_count, unpacked, whole_text, with_null,
                                   without_null)
from lumenframe.llm.components import components
from lumenframe.session import materialise

WIDTH = 64
SHINGLE = 3
MOST_BITS = 3
SEED = 42
BLOCKS = 8
#: Cost of one shuffled probe in units of one compared candidate.
PROBE_COST = 200.0
#: Largest bucket that one task compares; larger ones are cut into a grid of such pieces.
BUCKET_ROWS = 20_000
SMALL_GROUP = 64


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words."""
    from functools import partial

    import xxhash
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
        total = len(words) - size + 1
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype="<u8", count=total)
    ones = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, total, 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, size) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield batch[["id", "no_id", "row"]].assign(fp=prints)
    return run


def _bit_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of fingerprints in which bits i and j are both set, summed over a partition."""
    sums = np.zeros((WIDTH, WIDTH))
    for batch in batches:
        values = batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float64)
        sums += bits.T @ bits
    i, j = np.nonzero(sums)
    yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": sums[i, j].astype(np.int64)})


def correlated_blocks(both: np.ndarray, total: int) -> list[list[int]]:
    """The bits in ``BLOCKS`` equal blocks; each block starts with a bit and takes in those most correlated with it."""
    share = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(share, share)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    tie = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, blocks = set(range(WIDTH)), []
    while left:
        order = sorted(left)
        block = [max(order, key=lambda b: (tie[b, order].sum(), -b))]
        left.discard(block[0])
        while len(block) < WIDTH // BLOCKS:
            block.append(max(sorted(left), key=lambda b: (tie[b, block].sum(), -b)))
            left.discard(block[-1])
        blocks.append(sorted(block))
    return blocks


def _distances(histogram: np.ndarray, total: int) -> np.ndarray:
    """Share of ordered pairs of rows by how many bits of a block differ."""
    size = len(histogram)
    p = histogram / max(total, 1)
    transformed = p.copy()
    step = 1
    while step < size:  # Walsh-Hadamard: its square gives the histogram of xors
        t = transformed.reshape(-1, 2, step)
        transformed = np.concatenate([t[:, :1] + t[:, 1:], t[:, :1] - t[:, 1:]], axis=1).reshape(-1)
        step *= 2
    xors = transformed ** 2
    step = 1
    while step < size:
        t = xors.reshape(-1, 2, step)
        xors = np.concatenate([t[:, :1] + t[:, 1:], t[:, :1] - t[:, 1:]], axis=1).reshape(-1)
        step *= 2
    return np.bincount(np.bitwise_count(np.arange(size, dtype=np.uint32)), weights=xors / size)


def allot_thresholds(widths: list[int], near: list[np.ndarray], total: int, most: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 with sum ``most - partitions + 1`` and the least estimated cost, by dynamic programming."""
    goal = most - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, shares in zip(widths, near):
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t in range(-1, min(most, width) + 1):
                own = 0.0
                if t >= 0:
                    probes = sum(comb(width, d) for d in range(t + 1))
                    own = PROBE_COST * total * (1 + probes) / 2 + total * (total / 2) * float(shares[:t + 1].sum())
                if have + t not in step or cost + own < step[have + t][0]:
                    step[have + t] = (cost + own, [*chosen, t])
        best = step
    return best.get(goal, (float("inf"), []))


def plan_partitions(both: np.ndarray, histograms: np.ndarray, blocks: list[list[int]], total: int,
                    most: int) -> list[tuple[list[int], int]]:
    """Partitions (lists of bits) with their thresholds; those with -1 are left out."""
    spread = [_distances(h, total) for h in histograms]
    best = (float("inf"), [])
    for count in range(1, BLOCKS + 1):
        dealt = [list(p) for p in np.array_split(np.arange(BLOCKS), count)]
        widths, near = [], []
        for part in dealt:
            shares = np.ones(1)
            for b in part:  # blocks taken as independent of each other
                shares = np.convolve(shares, spread[b])
            widths.append(sum(len(blocks[b]) for b in part))
            near.append(shares)
        cost, thresholds = allot_thresholds(widths, near, total, most)
        if cost < best[0]:
            best = (cost, [(sorted(x for b in part for x in blocks[b]), t)
                           for part, t in zip(dealt, thresholds) if t >= 0])
    return best[1]


def _prober(plan: list[tuple[list[int], int]]):
    """Rows (part, key, role, fp, node): role 0 holds the key itself, role 1 comes from a larger key nearby."""
    parts = []
    for bits, t in plan:
        flips = [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(bits, d)]
        parts.append((np.uint64(sum(1 << b for b in bits)), np.array(flips, dtype=np.uint64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, node = batch["fp"].to_numpy().astype(np.int64).view(np.uint64), batch["node"].to_numpy()
            for i, (mask, flips) in enumerate(parts):
                own = fp & mask
                yield pd.DataFrame({"part": np.full(len(fp), i, np.int32), "key": own.view(np.int64),
                                    "role": np.zeros(len(fp), np.int32), "fp": fp.view(np.int64), "node": node})
                for flip in flips:
                    near = own ^ flip
                    keep = near < own
                    if keep.any():
                        k = int(keep.sum())
                        yield pd.DataFrame({"part": np.full(k, i, np.int32), "key": near[keep].view(np.int64),
                                            "role": np.ones(k, np.int32), "fp": fp[keep].view(np.int64),
                                            "node": node[keep]})
    return run


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray, out: list) -> None:
    """Union the pairs; keep those that joined two trees. ``parent`` is flat afterwards."""
    differ = parent[a] != parent[b]
    for x, y in zip(a[differ].tolist(), b[differ].tolist()):
        p, q = _find(parent, x), _find(parent, y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def link_bucket_rows(group: np.ndarray, role: np.ndarray, fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of positions that tie together, within each group, all rows linked through a row of role 0.

    Rows stand in order of group and role. Only the pairs that join two trees come out: fewer than there are rows.
    """
    n = len(group)
    parent = np.arange(n)
    out: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    for shift in range(1, min(SMALL_GROUP, int(sizes.max(initial=0)))):
        a = np.flatnonzero((group[:-shift] == group[shift:]) & small[:-shift] & (role[:-shift] == 0))
        if not len(a):
            break
        hit = np.bitwise_count(fp[a] ^ fp[a + shift]) <= most
        _join_up(parent, a[hit], a[hit] + shift, out)
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        end = start + size
        firsts = int((role[start:end] == 0).sum())
        for at in range(start, start + firsts, 256):
            rows = np.arange(at, min(at + 256, start + firsts))
            for other in range(at, end, 65_536):
                block = np.arange(other, min(other + 65_536, end))
                i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[block][None, :]) <= most)
                _join_up(parent, rows[i], block[j], out)
    return out


def _linker(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None

        def linked(rows: pd.DataFrame) -> pd.DataFrame:
            new = np.zeros(len(rows), dtype=bool)
            new[:1] = True
            for c in ("part", "key", "slice"):
                v = rows[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            fp = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
            pairs = link_bucket_rows(np.cumsum(new), rows["role"].to_numpy(), fp, most)
            node = rows["node"].to_numpy()
            at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": node[at[:, 0]], "b": node[at[:, 1]]})

        for batch in batches:
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            if not len(batch):
                continue
            last = batch.iloc[-1]
            cut = int(((batch["part"] != last["part"]) | (batch["key"] != last["key"])
                       | (batch["slice"] != last["slice"])).to_numpy().nonzero()[0].max(initial=-1)) + 1
            carry = batch.iloc[cut:]
            if cut:
                yield linked(batch.iloc[:cut])
        if carry is not None and len(carry):
            yield linked(carry)
    return run


def link_fingerprints(classes: DataFrame, most: int = MOST_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``classes``: fp (distinct), node. Edges a, b that connect all nodes linked by at most ``most`` differing bits.

    Edges are those of trees: they keep what is connected and leave out further pairs. Statistics that come to the
    driver are 64 x 64 counts of bit pairs and 8 x 256 counts of block values. A bucket of more than ``bucket_rows``
    rows is cut into a grid: its rows of role 0 into slices downwards, all its rows into slices across. A cell compares
    one slice of each, about ``bucket_rows`` rows, so no task holds a bucket; every pair with a row of role 0 meets.
    """
    spark = classes.sparkSession
    both, total = np.zeros((WIDTH, WIDTH)), classes.count()
    for r in (classes.select("fp").mapInPandas(_bit_pairs, "i int, j int, n long")
              .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()):
        both[r["i"], r["j"]] = r["n"]
    blocks = correlated_blocks(both, total)
    values = [sum([F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)).cast("int"), k)
                   for k, b in enumerate(bits)], F.lit(0)) for bits in blocks]
    histograms = np.zeros((BLOCKS, 2 ** (WIDTH // BLOCKS)))
    for r in (classes.select(F.posexplode(F.array(*values)).alias("block", "value"))
              .groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).collect()):
        histograms[r["block"], r["value"]] = r["n"]
    plan = plan_partitions(both, histograms, blocks, total, most)

    probes = classes.mapInPandas(_prober(plan), "part int, key long, role int, fp long, node long")
    in_slices = lambda n: F.ceil(n / F.lit(bucket_rows)).cast("long")
    hot = (probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("role")).alias("firsts"))
           .filter(F.col("n") > bucket_rows)
           .select("part", "key", in_slices(F.col("firsts")).alias("down"), in_slices(F.col("n")).alias("across")))
    hot = materialise(hot, "hot-buckets")
    if hot.limit(1).count():
        probes = probes.join(hot, ["part", "key"], "left")
        number = F.xxhash64("fp")
        own = F.pmod(number, F.greatest("down", F.lit(1)))
        cell = lambda d, a, role: F.struct((d * F.col("across") + a).alias("slice"), F.lit(role).alias("r"))
        as_first = F.transform(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda a: cell(own, a, 0))
        upto = F.when(F.col("role") == 0, own).otherwise(F.col("down"))
        as_other = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("down")), lambda d: d < upto),
                               lambda d: cell(d, F.pmod(number, F.col("across")), 1))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("slice"), F.col("role").alias("r")))
        dealt = (F.when(F.col("across").isNull(), whole)
                 .when(F.col("role") == 0, F.concat(as_first, as_other)).otherwise(as_other))
        probes = probes.withColumn("d", F.explode(dealt)).select(
            "part", "key", F.col("d.slice").alias("slice"), F.col("d.r").alias("role"), "fp", "node")
    else:
        probes = probes.withColumn("slice", F.lit(0).cast("long"))
    order = ["part", "key", "slice", "role"]
    return (probes.select(*order, "fp", "node").repartition(task_count(spark), "part", "key", "slice")
            .sortWithinPartitions(*order).mapInPandas(_linker(most), "a long, b long"))


def near_groups(df: DataFrame, id: str, text: str, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hexadecimal digits), component_id, and the row's number ROW_ID.

    Links hold between any two fingerprints that differ in at most ``most`` bits, so empty texts (fingerprint zero)
    link like others. component_id is the smallest id reachable. Rows whose id is null have their fingerprint and take
    part by it, but lend no id. An empty table gives an empty result.
    """
    number = F.col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    rows = df.select(*without_null(id), whole_text(text).alias("text"), number.alias("row"))
    prints = materialise(rows.mapInPandas(_fingerprints(size), "id long, no_id boolean, row long, fp long")
                         .select(with_null("id"), "row", "fp"), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.min("row").alias("node"),
                                                   F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    ties = components(link_fingerprints(classes.select("fp", "node"), most))
    tied = classes.join(ties, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(tied.join(smallest, "component").select("fp", "component_id", "component", "n"), "near-classes")
    found = look_up(prints, named, ["fp"], "n")
    return found.select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id", "component", F.col("row").alias(ROW_ID))


def keep_one_of_each(df: DataFrame, id: str, text: str, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """The rows of ``df``, one per group of near copies: the smallest id, of equal ids the first row."""
    rows = materialise(df.select(packed(df), F.monotonically_increasing_id().alias(ROW_ID)), "near-rows")
    groups = near_groups(rows.select(f"{ROW}.*", ROW_ID), id, text, size, most)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col(id).isNull(), F.col(id), F.col(ROW_ID).alias("r")))
                                            .alias("first"))
    return unpacked(rows.join(first.select(F.col("first.r").alias(ROW_ID)), ROW_ID, "left_semi"))
