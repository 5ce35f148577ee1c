"""Minimax contiguous sharding.

Rows of equal text form an atomic group. Groups are ordered by a digest of their text; the
smallest shard capacity for which a greedy pass needs no more than the wanted shards is found by
binary search over the ordered group sizes, and the order is cut there.

The driver never sees the groups one by one. It holds the order as segments (all groups whose
digest begins with some hex digits) with their sums, brackets the capacity between a pass in
which segments are atomic and one in which only single groups are, and has Spark split the
segments in which the two passes' cuts can differ until both agree.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Hex digits by which the order is divided at first, and more at each split.
FIRST, MORE = 3, 2


@dataclass(frozen=True, order=True)
class Segment:
    prefix: str
    size: int
    groups: int


def atomic_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Greedy cuts before which elements begin a new shard; an element beyond the capacity is alone."""
    sums, cuts, at = [0, *accumulate(sizes)], [], 0
    while at < len(sizes):
        at = max(at + 1, bisect.bisect_right(sums, sums[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def fluid_cuts(segments: list[Segment], capacity: int) -> list[int]:
    """As atomic_cuts, but for segments of many groups, which may be cut anywhere; a cut's place is
    the segment that it falls into. No contiguous cutting of the groups needs fewer shards."""
    cuts, room = [], capacity
    for i, s in enumerate(segments):
        if s.groups == 1:
            if s.size > room:
                cuts.append(i)
                room = capacity
            room -= s.size
            continue
        left = s.size
        while left > room:
            left -= room
            cuts.append(i)
            room = capacity
        room -= left
    return [*cuts, len(segments)]


def smallest(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def bracket(segments: list[Segment], shards: int) -> tuple[int, int, set[int]]:
    """Bounds of the smallest capacity, and the segments of many groups in which cuts may differ."""
    sizes = [s.size for s in segments]
    total = sum(sizes)
    least = max([-(-total // shards), *(s.size for s in segments if s.groups == 1)])
    low = smallest(least, total, lambda c: len(fluid_cuts(segments, c)) <= shards)
    high = smallest(max(low, *sizes), total, lambda c: len(atomic_cuts(sizes, c)) <= shards)
    if low == high:
        return low, high, set()
    zones: set[int] = set()
    for a, b in zip(atomic_cuts(sizes, low), fluid_cuts(segments, high), strict=False):
        zones |= {i for i in range(max(0, min(a, b) - 1), min(len(segments), max(a, b) + 1)) if segments[i].groups > 1}
    return low, high, zones or {i for i, s in enumerate(segments) if s.groups > 1}


def balanced(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near as possible to an equal share of what is left."""
    sums, n = [0, *accumulate(sizes)], len(sizes)
    need = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[bisect.bisect_right(sums, sums[i] + capacity) - 1]
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        far = bisect.bisect_right(sums, sums[at] + capacity) - 1
        want = sums[at] + (sums[n] - sums[at]) / left
        k = bisect.bisect_left(sums, want, at, far + 1)
        if k > at and (k > far or abs(sums[k - 1] - want) <= abs(sums[k] - want)):
            k -= 1
        while need[k] > left - 1:
            k += 1
        cuts.append(k)
        at = k
    return cuts


def cut_points(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digests (or their beginnings) at which shards 1, 2, ... begin, and the smallest capacity.

    `groups` has gid (32 hex digits) and bytes, one row a group. Each round collects at most
    16**FIRST rows, or 16**MORE for each segment in which two cuts may differ.
    """

    def sums(rows: DataFrame, digits: int) -> list[Segment]:
        got = rows.groupBy(F.substring("gid", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return sorted(Segment(r["p"], int(r["b"]), r["n"]) for r in got)

    segments = sums(groups, FIRST)
    if not segments:
        return [], 0
    while True:
        low, high, split = bracket(segments, shards)
        if low == high:
            break
        by: dict[int, list[str]] = {}
        for i in split:
            by.setdefault(len(segments[i].prefix), []).append(segments[i].prefix)
        kept = [s for i, s in enumerate(segments) if i not in split]
        for digits, prefixes in by.items():
            kept += sums(groups.where(F.substring("gid", 1, digits).isin(prefixes)), min(32, digits + MORE))
        segments = sorted(kept)
    cuts = balanced([s.size for s in segments], high, shards)
    return [segments[k].prefix if k < len(segments) else "g" for k in cuts], high


def shard(docs: DataFrame, scratch: Scratch, *, shards: int = 16, slot_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity of every row of doc_id and text.

    A row's size is its text's UTF-8 bytes plus 1; null counts as the empty text. Slots number a
    shard's rows without gaps: rows are dealt into buckets of about `slot_rows` by a hash of
    doc_id and text, numbered within, and offset by the buckets before, so neither a shard nor a
    group of copies is ever sorted in one task. Rows without an id, of which there may be very many
    of one text, are dealt by their place when first read. Repeated rows get a slot each. An empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = scratch.cut(docs.select("doc_id", (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("gid"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_place")), "rows")
    groups = scratch.cut(rows.groupBy("gid").agg(F.sum("size").alias("bytes")), "groups")
    starts, capacity = cut_points(groups, shards)
    n = rows.count()
    place = sum((F.when(F.col("gid") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")
    dealt = rows.withColumn("shard", place).withColumn("_sub", F.pmod(F.xxhash64("doc_id", "gid", "_place"), F.lit(max(1, -(-n // slot_rows)))))
    counts = dealt.groupBy("shard", "_sub").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("count")).drop("count")
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("gid", "doc_id")))
    return numbered.join(before, ["shard", "_sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )
