"""Sharding by a minimax contiguous partition of ordered atomic groups; the law that holds is `bytes`.

Equal texts form a group. Groups are ordered by a 64-bit hash of the text (as a signed number) and never cut. The capacity is the
smallest feasible one for the groups, however many there are: the driver first gets the sizes of units, groups whose hashes agree
in the first ``unit_bits`` bits (at most 2**unit_bits rows: a million longs), and then the groups of those few units alone that a cut
may fall into, until the greedy fill below the capacity found fails without touching a unit that was not looked into. That fill is
then the fill over all groups, so no smaller capacity is feasible.

`capacity` binary-searches the smallest capacity for which a greedy left-to-right fill needs at most the wanted number of
shards. Among the partitions under that capacity, the cuts are then placed so that no shard stays empty while there are units
left, by filling each shard up to the lesser of the capacity and its fair share of what is left. One very large group of
copies fills a shard by itself: it cannot be cut, and it sets the capacity.

Slots number the rows of a shard from 0 without gaps: rows are blocked by a hash of doc_id, the few (block, shard) counts give
each block its offset, and row_number runs within a block, so no window ever holds a shard, a source or a group of copies.

Edge cases: null text counts as the empty text (16 bytes of overhead, CRC 0) and forms one group with it; null doc_id is a
value like another; repeated rows each get a slot of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

SHARDS = 40
UNIT_BITS = 20
OVERHEAD = 16
ROWS_PER_BLOCK = 50_000
#: Capacities tried in one look for units that a cut may fall into.
PROBES = 8


def feasible(sizes: np.ndarray, capacity: int, shards: int) -> bool:
    """Whether a greedy fill in order needs at most `shards` shards of `capacity`."""
    if len(sizes) and int(sizes.max()) > capacity:
        return False
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    for _ in range(shards):
        if at >= len(sizes):
            return True
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
    return at >= len(sizes)


def capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest feasible shard capacity."""
    if not len(sizes):
        return 0
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(sizes, mid, shards) else (mid + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """End positions of the shards, under the smallest feasible capacity. A shard is filled up to its fair share of what is
    left when the rest still fits, else up to the capacity."""
    most = capacity(sizes, shards)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # the earliest start from which the last k shards can hold the rest
    latest = [len(sizes)]
    for _ in range(shards):
        latest.append(int(np.searchsorted(ends, ends[latest[-1]] - most, side="left")))
    out, at = [], 0
    for k in range(shards):
        left = shards - k
        full = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        aim = ends[at] + (ends[-1] - ends[at]) / left
        fair = int(np.searchsorted(ends, aim, side="left"))
        if fair > at + 1 and aim - ends[fair - 1] <= ends[min(fair, len(sizes))] - aim:
            fair -= 1
        at = max(min(fair, full), min(latest[left - 1], full), at)
        out.append(at)
    out[-1] = len(sizes)
    return out


def stops(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The first atom of each shard but the first in a greedy fill: what did not fit any more."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        if at >= len(sizes):
            break
        out.append(at)
    return out


def refined(keys: np.ndarray, sizes: np.ndarray, whole: np.ndarray, shards: int, look, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Atoms (their first keys, sizes) over which the smallest feasible capacity is that of all groups. whole: whether an atom is one
    group; look(keys) gives (keys, sizes) of the groups of the units that begin there, in order."""
    while len(sizes) and not whole.all():
        most = capacity(sizes, shards)
        least = -(-int(sizes.sum()) // shards)
        if all(whole[i] for i in stops(sizes, most - 1, shards)):
            break
        tried = {most - 1, *np.linspace(min(least, most - 1), most - 1, probes).astype(np.int64).tolist()}
        open_ = sorted({i for c in tried for i in stops(sizes, c, shards) if not whole[i]})
        new_keys, new_sizes = look(keys[open_])
        rest = np.ones(len(sizes), bool)
        rest[open_] = False
        keys, sizes, whole = np.concatenate([keys[rest], new_keys]), np.concatenate([sizes[rest], new_sizes]), np.concatenate([whole[rest], np.ones(len(new_keys), bool)])
        order = np.argsort(keys, kind="stable")
        keys, sizes, whole = keys[order], sizes[order], whole[order]
    return keys, sizes


def assign(docs: DataFrame, *, shards: int = SHARDS, unit_bits: int = UNIT_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only the `key` law grows)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the text is read once; what follows needs about 32 bytes a row
    rows = C.written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")), "shard-rows")
    groups = C.written(rows.groupBy("hash").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("unit", F.shiftright("hash", 64 - unit_bits).cast("int")), "shard-groups")
    # columns, not rows: 40 bytes a unit
    units = groups.groupBy("unit").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("hash").alias("first"), F.count(F.lit(1)).alias("many")).toArrow().sort_by("first")

    def look(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [int(x) >> (64 - unit_bits) for x in first]
        found = groups.where(F.col("unit").isin(own)).select("hash", "s").toArrow().sort_by("hash")
        return found["hash"].to_numpy(), found["s"].to_numpy()

    keys, sizes = refined(units["first"].to_numpy(), units["s"].to_numpy(), units["many"].to_numpy() == 1, shards, look)
    C.dropped(groups)
    ends = cuts(sizes, shards)
    # the first hash of the shards after the first; shards past the last group hold nothing
    first = [int(keys[e]) for e in ends[:-1] if e < len(keys)]
    total = int(units["n"].to_numpy().sum())
    blocks = max(1, -(-total // ROWS_PER_BLOCK))
    shard: Column = F.lit(0)
    for x in first:
        shard = shard + (F.col("hash") >= F.lit(x)).cast("int")
    placed = C.written(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")), "shard-placed")
    C.dropped(rows)
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("shard").alias("s"), F.col("block").alias("b"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = placed.withColumn("own", own)
    return (
        numbered.join(offsets, (numbered["shard"] == offsets["s"]) & (numbered["block"] == offsets["b"]))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return assign(C.table(spark, sf_dir, "documents"))
