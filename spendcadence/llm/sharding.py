"""Minimax contiguous sharding: the smallest shard capacity for which a greedy pass over ordered groups fits.

Equal texts are one atomic group (null counts as empty).  Groups are ordered by the 128-bit hash of their
text, so a shard is one range of hashes and a row finds its shard by comparing its own hash with the cuts:
no join and no window over groups.  The capacity is found by binary search with a greedy check.  The driver
holds group sizes only as sums over hash prefixes (4096 to a prefix), which bound each greedy step from
below and above; the few prefixes in which a cut may fall are split further by one more pass over the narrow
rows, until the bounds meet.  That gives the exact optimum with at most some thousands of sums on the driver
at a time, however many groups there are; twelve more bits of hash are settled by each pass.

A null id is an ordinary value (it sorts first).  Rows that repeat are separate rows with slots of their own.
Fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.llm.shared import cut, filled, numbered, rank_blocks

DIGITS = 3  # hex digits of hash settled by one pass


@dataclass(frozen=True)
class Cell:
    """Groups whose hash starts with ``prefix``: their sizes fill [start, end) of all sizes in hash order."""

    prefix: str
    start: int
    end: int
    single: bool  # one group only


def summed(rows: DataFrame, digits: int, inside: list[str] | None = None) -> list[tuple[str, int, bool]]:
    """Sizes summed by the first ``digits`` hex digits of the hash, within the given shorter prefixes."""
    if inside is not None:
        rows = rows.filter(F.substring("_hash", 1, digits - DIGITS).isin(inside))
    sums = rows.groupBy(F.substring("_hash", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("size"), (F.min("_hash") == F.max("_hash")).alias("single")
    )
    return sorted((r["prefix"], r["size"], r["single"]) for r in sums.collect())


def laid_out(sums: list[tuple[str, int, bool]], start: int = 0) -> list[Cell]:
    cells = []
    for prefix, size, single in sums:
        cells.append(Cell(prefix, start, start + size, single))
        start += size
    return cells


def greedy(cells: list[Cell], starts: list[int], shards: int, capacity: int, hopeful: bool) -> list[int]:
    """Where each shard ends if it takes all it can hold.

    Inside a cell of several groups the true end is not known: it is at least the cell's start, and at most
    the full capacity.  ``hopeful`` takes the latter.
    """
    at, ends = 0, []
    for _ in range(shards):
        reach = at + capacity
        cell = cells[bisect_right(starts, reach) - 1]
        if reach >= cell.end:
            at = cell.end
        else:
            at = reach if hopeful and not cell.single else max(at, cell.start)
        ends.append(at)
    return ends


def smallest(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the hash prefixes at which shards 1, 2, ... begin."""
    cells = laid_out(summed(rows, DIGITS))
    if not cells:
        return 0, []
    total = cells[-1].end
    digits = DIGITS
    while True:
        starts = [c.start for c in cells]
        least = smallest(1, total, lambda c: greedy(cells, starts, shards, c, True)[-1] >= total)
        sure = smallest(least, total, lambda c: greedy(cells, starts, shards, c, False)[-1] >= total)
        if least == sure:
            break
        early, late = greedy(cells, starts, shards, least, False), greedy(cells, starts, shards, sure, True)
        spans = [(a + least, b + sure) for a, b in zip([0, *early], [0, *late])]
        open_cells = [
            c
            for c in cells
            if not c.single and len(c.prefix) == digits and any(c.start <= b and c.end >= a for a, b in spans)
        ]
        finer: dict[str, list[tuple[str, int, bool]]] = {}
        for row in summed(rows, digits + DIGITS, [c.prefix for c in open_cells]):
            finer.setdefault(row[0][:digits], []).append(row)
        cells = [f for c in cells for f in (laid_out(finer[c.prefix], c.start) if c.prefix in finer else [c])]
        digits += DIGITS
    ends = greedy(cells, starts, shards, sure, False)
    begins = {c.start: c.prefix for c in cells}
    return sure, [begins[e] for e in ends if e < total]


def shard_of(cuts: list[str]) -> Column:
    number = F.lit(0)
    for begin in cuts:
        number = number + (F.col("_hash") >= begin).cast("int")
    return number


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot: shards of nearly equal bytes, equal texts together."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(filled(text_col)) + 1).cast("long").alias("size"),
            F.crc32(filled(text_col)).alias("text_crc32"),
            F.md5(filled(text_col)).alias("_hash"),
        )
    )
    placed = rows.withColumn("shard", shard_of(minimax_cuts(rows, shards)[1]))
    return numbered(placed, ["shard"], ["_id", "_hash"], "slot", rank_blocks(rows.count())).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot"
    )
