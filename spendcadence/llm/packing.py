"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document is its token ids and an end id; one longer than a sequence is cut into full pieces and a shorter
last one.  Best fit, longest first, runs over counts of equal lengths rather than over documents: the plan
says which ranks of a length go to which run of sequences at which offset.  Pieces are then numbered within
their length and take their slots by a join on (length, rank).

The histogram has at most ``capacity`` rows, and every planning step uses up a run of sequences or a length
and leaves at most two new runs, so plan and broadcast are bounded by a small multiple of ``capacity``
whatever the number of documents.  Texts are tokenised once; the narrow pieces are written to the shared
checkpoint folder and everything else reads those.  Numbering splits a hot length into blocks.

Null text counts as empty: one piece that holds the end id alone.  Rows that repeat are packed each on their
own.  An empty table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.bpe_codec import ID, codec, with_text
from spendcadence.llm.shared import cut, numbered, rank_blocks


class Slots(NamedTuple):
    """Ranks [first, first + taken) of a length, ``each`` to a sequence, from sequence ``sequence`` on."""

    length: int
    first: int
    taken: int
    each: int
    sequence: int
    place: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over counts of lengths."""
    plan: list[Slots] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    rooms: list[int] = []
    used = 0

    def leave(room: int, sequence: int, sequences: int) -> None:
        if sequences and room:
            if not open_runs.get(room):
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((sequence, sequences))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, sequences = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(at)
            else:
                room = capacity
                sequence, sequences = used, -(-left // (capacity // length))
                used += sequences
            # A sequence that has just taken one is again the tightest while it has room for another.
            each = room // length
            full = min(sequences, left // each)
            if full:
                plan.append(Slots(length, rank, full * each, each, sequence, capacity - room))
                leave(room - each * length, sequence, full)
                rank, left = rank + full * each, left - full * each
            sequence, sequences = sequence + full, sequences - full
            if left and sequences:
                plan.append(Slots(length, rank, left, left, sequence, capacity - room))
                leave(room - left * length, sequence, 1)
                left, sequence, sequences = 0, sequence + 1, sequences - 1
            leave(room, sequence, sequences)
    return plan


def token_pieces(
    docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, id_col: str, text_col: str
) -> DataFrame:
    """_id, piece, start, length, ids_crc32 for each piece of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(vocabulary_path)
        end = end_id.to_bytes(ID.itemsize, "little")
        width = capacity * ID.itemsize
        for batch in batches:
            rows, pieces, lengths, sums = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = tokens.encode(text.as_py()) + end
                for piece, start in enumerate(range(0, len(ids), width)):
                    part = ids[start : start + width]
                    rows.append(row)
                    pieces.append(piece)
                    lengths.append(len(part) // ID.itemsize)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array([p * capacity for p in pieces], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = with_text(docs, id_col, text_col)
    schema = T.StructType(
        [
            rows.schema["_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    return rows.mapInArrow(work, schema)


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int = 1,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    pieces = cut(token_pieces(docs, vocabulary_path, end_id, capacity, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        [(s.length, s.first, s.first + s.taken, s.each, s.sequence, s.place) for s in best_fit(counts, capacity)],
        "length long, _first long, _past long, _each long, _sequence long, _place long",
    )
    ranked = numbered(pieces, ["length"], ["_id", "piece", "ids_crc32"], "_rank", rank_blocks(sum(counts.values())))
    taken = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(plan), "length")
        .filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_past")))
        .select(
            F.col("_id").alias(id_col),
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("_sequence") + F.floor(taken / F.col("_each"))).alias("sequence_id"),
            (F.col("_place") + F.pmod(taken, F.col("_each")) * F.col("length")).alias("offset"),
        )
    )
