"""Fingerprints of whole texts from prefix polynomial hashes.

A text's code points c0, c1, ... give the prefix sums of (c + 1) * B**i under two primes.  From these arrays the hash of
any span follows in constant time, so equal spans are told at once, and the longest common extension of two places is
found by binary search (:class:`Prefix`).

A fingerprint is, in hexadecimal, the hash of the whole text (16 digits) and the ``KEPT`` smallest of the mixed hashes of
all its spans of ``WIDTHS`` code points (8 digits each).  Equal texts have equal fingerprints.  The likeness of two
fingerprints estimates the Jaccard similarity of the two sets of spans; it is 1 for equal texts and two empty ones, exact
for sets of at most ``KEPT`` spans, and has a standard deviation of at most 0.07 beyond.  A text shorter than the
least width is its only span.

:func:`with_neighbours` gives every document the next one in descending order of ids (after the last: the first) in one
shuffle of the texts: documents are dealt to intervals of ids, sorted there and streamed, and the last document of
an interval is copied into the following one as a guest.  Splitters, and the texts of guests, are one for each of at most
``INTERVALS`` intervals.  An id that fills whole intervals has one of its own, whose rows are dealt further by their text.

Null text counts as empty.  Rows that repeat an id have the same next document; of several texts under one id the
smallest by UTF-8 bytes is the next one for others.  A row with a null id has no place in the order: its text is
fingerprinted, and what depends on a next document is null.  A document alone is its own next.  Ids are integers.  An
empty table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.shared import filled
from spendcadence.llm.shingles import mixed

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525413)
LOW = 1 << 16  # powers held in one table
CHUNK = 1 << 20  # spans hashed at once
WIDTHS = (2, 10)
KEPT = 64
INTERVAL_BYTES = 2 << 20
INTERVALS = 10_000


class Powers:
    """B**i and B**-i for i up to 2**32, from four small tables."""

    def __init__(self, base: int, prime: int):
        self.prime = np.uint64(prime)
        self.low, self.high = self.table(base), self.table(pow(base, LOW, prime))
        inverse = pow(base, -1, prime)
        self.low_back, self.high_back = self.table(inverse), self.table(pow(inverse, LOW, prime))

    def table(self, base: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < LOW:
            step = np.uint64(pow(base, len(out), int(self.prime)))
            out = np.concatenate([out, out * step % self.prime])
        return out

    def of(self, low: np.ndarray, high: np.ndarray, first: int, past: int) -> np.ndarray:
        if past <= LOW:
            return low[first:past]
        i = np.arange(first, past)
        return low[i % LOW] * high[i // LOW] % self.prime

    def forth(self, first: int, past: int) -> np.ndarray:
        return self.of(self.low, self.high, first, past)

    def back(self, first: int, past: int) -> np.ndarray:
        return self.of(self.low_back, self.high_back, first, past)


POWERS = [Powers(base, prime) for base, prime in zip(BASES, PRIMES)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prefix:
    """Prefix hashes of a text under both primes."""

    def __init__(self, points: np.ndarray, start: Prefix | None = None, shared: int = 0):
        """Of ``points``; the first ``shared`` of them are those of ``start``, whose sums are taken over."""
        self.points = points
        self.sums = []
        for k, powers in enumerate(POWERS):
            sums = np.zeros(len(points) + 1, np.uint32)
            if start is not None:
                sums[: shared + 1] = start.sums[k][: shared + 1]
            for first in range(shared, len(points), CHUNK):
                past = min(len(points), first + CHUNK)
                terms = (points[first:past].astype(np.uint64) + np.uint64(1)) * powers.forth(first, past) % powers.prime
                sums[first + 1 : past + 1] = (np.cumsum(terms) + np.uint64(sums[first])) % powers.prime
            self.sums.append(sums)

    def __len__(self) -> int:
        return len(self.points)

    def spans(self, first: int, past: int, width: int) -> np.ndarray:
        """Hashes of the spans of ``width`` points that start at ``first`` to ``past`` - 1."""
        out = np.zeros(past - first, np.uint64)
        for sums, powers in zip(self.sums, POWERS):
            difference = sums[first + width : past + width].astype(np.uint64) + powers.prime - sums[first:past]
            out = out << np.uint64(31) | difference * powers.back(first, past) % powers.prime
        return out

    def span(self, first: int, past: int) -> int:
        return int(self.spans(first, first + 1, past - first)[0])

    def extension(self, at: int, other: Prefix, other_at: int) -> int:
        """How many points from ``at`` on equal those of ``other`` from ``other_at`` on."""
        low, high = 0, min(len(self) - at, len(other) - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(other_at, other_at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def extension_back(self, at: int, other: Prefix, other_at: int) -> int:
        """How many points before ``at`` equal those of ``other`` before ``other_at``."""
        low, high = 0, min(at, other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at - middle, at) == other.span(other_at - middle, other_at):
                low = middle
            else:
                high = middle - 1
        return low

    def least(self, first: int, past: int) -> np.ndarray:
        """The KEPT smallest mixed hashes of the spans that start at ``first`` to ``past`` - 1."""
        found = np.zeros(0, np.uint64)
        for width in WIDTHS:
            width = min(width, len(self)) if width == WIDTHS[0] else width
            salt = np.uint64(width << 56)
            for low in range(first, min(past, len(self) - width + 1), CHUNK):
                high = min(past, len(self) - width + 1, low + CHUNK)
                found = smallest(np.concatenate([found, mixed(self.spans(low, high, width) ^ salt)]))
        return found

    def fingerprint(self, start: np.ndarray | None = None, shared: int = 0) -> str:
        """With ``start`` the smallest hashes of the spans that start before ``shared``, if they are known."""
        if not len(self):
            return f"{0:016x}"
        found = self.least(shared, len(self))
        if start is not None:
            found = smallest(np.concatenate([start, found]))
        whole = mixed(np.array([self.span(0, len(self))], np.uint64) ^ np.uint64(len(self)))[0]
        return f"{int(whole):016x}" + (found >> np.uint64(32)).astype(">u4").tobytes().hex()


def smallest(values: np.ndarray) -> np.ndarray:
    """The KEPT smallest different values, in order."""
    if len(values) > 8 * KEPT:
        few = np.unique(np.partition(values, 4 * KEPT)[: 4 * KEPT])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(values)[:KEPT]


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if one[:16] == other[:16]:
        return 1.0
    a, b = ({f[k : k + 8] for k in range(16, len(f), 8)} for f in (one, other))
    union = sorted(a | b)[:KEPT]
    return sum(x in a and x in b for x in union) / len(union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint for each row, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = (Prefix(code_points(text.as_py())) for text in batch.column(1))
            found = [(len(p), p.fingerprint()) for p in prefixes]
            sizes, prints = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.string())], ["_id", "n_chars", "fingerprint"]
            )

    rows = docs.select(F.col(id_col).alias("_id"), filled(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], *COMPARED.fields[1:3]])
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def interval_of(splitters: list[int]):
    """A column function: how many splitters are at most the id."""
    edges = np.array(splitters, np.int64)

    @F.pandas_udf("long")
    def interval(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right"))

    return interval


def splitters_of(rows: DataFrame, least: int) -> list[int]:
    """Ids that cut the table into intervals of about INTERVAL_BYTES; ids that fill several are cut out."""
    size = rows.agg(F.sum(F.octet_length("_text") + F.lit(16))).first()[0] or 0
    count = int(min(INTERVALS, max(least, size // INTERVAL_BYTES)))
    shares = [k / count for k in range(1, count)]
    cuts = rows.agg(F.percentile_approx("_id", shares, 20 * count)).first()[0] if shares else []
    edges = set()
    for cut, again in zip(cuts or [], [*(cuts or [])[1:], None]):
        edges |= {cut, cut + 1} if cut == again else {cut}
    return sorted(edges)


def with_neighbours(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Rows (_interval, _slot, _row, _id, _text), sorted in partitions: a guest (_row false) precedes an interval's rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), filled(text_col).alias("_text")).filter("_id IS NOT NULL")
    splitters = splitters_of(rows, least)
    interval = interval_of(splitters)
    # At most twice as many intervals as INTERVALS, so these rows are bounded; ids alone are read for them.
    held = (
        rows.select("_id", interval("_id").alias("_interval"))
        .groupBy("_interval")
        .agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count(F.lit(1)).alias("rows"))
        .orderBy("_interval")
        .collect()
    )
    if not held:
        return rows.select(F.lit(0).cast("long").alias("_interval"), F.lit(0).alias("_slot"), F.lit(True).alias("_row"), "_id", "_text")
    usual = sum(h["rows"] for h in held) // len(held) + 1
    slots = {h["_interval"]: -(-h["rows"] // usual) if h["low"] == h["high"] else 1 for h in held}
    hot = {k: n for k, n in slots.items() if n > 1}
    slot_count = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("_interval")], F.lit(1)) if hot else F.lit(1)
    own = rows.withColumn("_interval", interval("_id")).select(
        "_interval", F.pmod(F.xxhash64("_text"), slot_count).cast("int").alias("_slot"), F.lit(True).alias("_row"), "_id", "_text"
    )
    # The largest id of an interval is the next document of the smallest id of the interval behind it.
    visits = [
        (int(before["high"]), int(h["_interval"]), slot)
        for before, h in zip([held[-1], *held[:-1]], held)
        for slot in range(slots[h["_interval"]])
    ]
    spark = docs.sparkSession
    visits = spark.createDataFrame(visits, "_id long, _interval long, _slot int")
    ends = sorted({int(h["high"]) for h in held})
    guests = (
        rows.filter(F.col("_id").isin(ends)).groupBy("_id").agg(F.min("_text").alias("_text")).join(F.broadcast(visits), "_id")
    )
    return (
        own.union(guests.select("_interval", "_slot", F.lit(False).alias("_row"), "_id", "_text"))
        .repartition("_interval", "_slot")
        .sortWithinPartitions("_interval", "_slot", "_row", "_id", "_text")
    )


COMPARED = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("shared_start", T.LongType()),
        T.StructField("shared_end", T.LongType()),
    ]
)


class Document:
    """A text with what is worked out from it once."""

    def __init__(self, text: str):
        self.text = text
        self.prefix = Prefix(code_points(text))
        # The spans inside the part that an edit leaves are hashed once for both fingerprints.
        self.kept = len(self.prefix) - len(self.prefix) // 2
        self.shared = max(0, self.kept - WIDTHS[-1] + 1)
        self.start = self.prefix.least(0, self.shared)
        self.fingerprint = self.prefix.fingerprint(self.start, self.shared)

    def compared(self, following: Document) -> tuple:
        """The columns of COMPARED after the id: the end of the text, half its length, replaced by the next text's start."""
        kept, half = self.kept, len(self.prefix) - self.kept
        edited = Prefix(np.concatenate([self.prefix.points[:kept], following.prefix.points[:half]]), self.prefix, kept)
        mark = edited.fingerprint(self.start, self.shared)
        digest = hashlib.sha256((self.text[:kept] + following.text[:half]).encode()).hexdigest()
        return (
            len(self.prefix), self.fingerprint, digest, mark, likeness(self.fingerprint, mark),
            likeness(self.fingerprint, following.fingerprint), self.prefix.extension(0, edited, 0),
            self.prefix.extension_back(len(self.prefix), edited, len(edited)),
        )


TOGETHER = 256  # result rows to a batch


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows with their guests; holds two documents."""
    owner = None
    following = first = None  # the next document, and the first of the id at hand
    rows: list[tuple] = []
    for batch in batches:
        own, ids = (batch.column(k).to_pylist() for k in (2, 3))
        for k in range(batch.num_rows):
            at = Document(batch.column(4)[k].as_py())
            if not own[k]:
                owner, first = None, at
                continue
            if owner != ids[k]:
                owner, following, first = ids[k], first, at
            rows.append((ids[k], *at.compared(following)))
            if len(rows) >= TOGETHER:
                yield as_batch(rows)
                rows = []
    if rows:
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    columns = [pa.array(x, kinds[f.dataType.simpleString()]) for f, x in zip(COMPARED, zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, COMPARED.names)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the columns of COMPARED for each row.

    The edited text is the text with its last n_chars div 2 code points replaced by the first as many of the next document
    (or all of it); shared_start and shared_end are the longest common start and end of both.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = with_neighbours(docs, id_col, text_col, least).mapInArrow(compare, COMPARED)
    others = fingerprints(docs.filter(F.col(id_col).isNull()), id_col, text_col)
    without = others.select(
        F.col(id_col).cast("long").alias("_id"), "n_chars", "fingerprint",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in COMPARED.fields[3:]],
    )
    return found.union(without).withColumnRenamed("_id", id_col)
