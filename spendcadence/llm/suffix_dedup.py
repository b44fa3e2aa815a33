"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte that is covered by a ``length``-byte string which also starts earlier (in a smaller id, or earlier in
the same document) goes.  Strings are judged on the input; matches never cross documents.

1. Each window of ``length`` bytes is assigned to an anchor, the place of its smallest ``GRAM``-byte hash.  Equal
   windows have equal anchors, and neighbouring windows mostly share one, so about one place in 35 stands for
   all windows.  Anchors whose hash occurs once can't hold a repeat; they are nearly all, and end here.
2. The stretches of text around the remaining anchors meet by anchor hash.  Each batch of them gets a suffix
   array (its windows in byte order); equal neighbours are repeats.  The array is merge-scanned against those of
   earlier batches with the same anchor, and arrays of like size merge, so there are logarithmically many.
   The earliest place of each string stays.  An array is forgotten when its anchor hash has passed.
3. Repeated windows become runs of bytes, and those are cut from the texts.

Texts of equal bytes are one text, its smallest id stands for all; the others lose every byte if they have a
window.  Within a batch equal stretches are settled at once and only the first travels on, so a passage that
very many documents share reaches its task once from each batch.

Ids are integers.  A row with a null id loses its text if one with an id has the same, and is left alone
otherwise.  Rows that repeat an id and text are one document.  Null text counts as empty.  Texts shorter than ``length`` are left
alone.  An empty table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.components import hub_join
from spendcadence.llm.repeats import repeated_rows, travel_keys
from spendcadence.llm.shared import cut, filled, likely
from spendcadence.llm.shingles import BASE, BYTE, INVERSE, blocks, buffers, mixed, powers

GRAM = 24
CHUNK = 1 << 20  # windows of one text worked on at once
PLACES = 21  # bits for a place within a block
FIELD = 16  # bits each for how far a run of windows begins before its anchor, and how many windows it has
LONGEST = 1 << FIELD  # that ``length`` may be
STRETCHES_TOGETHER = 8 << 20  # bytes of different stretches in one batch
WINDOWS_TOGETHER = 150_000  # windows to a suffix array


@lru_cache(maxsize=2)
def both_powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, count), powers(INVERSE, count)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    forth, back = both_powers(CHUNK * 2 + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * forth[: len(data)], out=sums[1:])
    places = len(data) - GRAM + 1
    return mixed((sums[GRAM:] - sums[:places]) * back[:places])


def anchors(data: np.ndarray, edges: np.ndarray, length: int):
    """Runs of windows with one anchor: row, anchor place, first window, number of windows, anchor hash.

    ``edges`` cuts ``data`` into rows; places count from the start of ``data``.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    hashes = gram_hashes(data)
    bits = np.uint64(PLACES)
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, done = length - GRAM + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: done - width], least[width - done :])
    place = (least & np.uint64((1 << PLACES) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(place)]
    inside = np.arange(len(place)) + length <= edges[row + 1]
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    runs = np.add.reduceat(inside.astype(np.int64), starts)
    at = place[starts]
    return row[starts], at, starts, runs, hashes[at]


def segments(offsets: np.ndarray, length: int):
    """Parts of at most CHUNK windows: (rows, first bytes, past bytes) of blocks of them."""
    for first, past in blocks(offsets):
        if past - first > 1 or offsets[past] - offsets[first] <= CHUNK + length - 1:
            yield np.arange(first, past), offsets[first:past], offsets[first + 1 : past + 1]
            continue
        for start in range(int(offsets[first]), int(offsets[past]), CHUNK):
            end = min(start + CHUNK + length - 1, int(offsets[past]))
            yield np.array([first]), np.array([start]), np.array([end])


def anchor_rows(length: int):
    """Rows (key, hash, id, packed, known) for the anchors of a batch; of equal texts only for the first.

    Of anchors with one hash in a batch the first is keyed by the hash, the others by anything (they carry the
    hash besides): that they repeat is known already.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            firsts: dict[bytes, int] = {}
            for k in range(batch.num_rows):
                digest = hashlib.blake2b(data[offsets[k] : offsets[k + 1]], digest_size=16).digest()
                if digest not in firsts or ids[k] < ids[firsts[digest]]:
                    firsts[digest] = k
            stands = np.zeros(batch.num_rows, bool)
            stands[list(firsts.values())] = True
            found = []
            for rows, begins, pasts in segments(offsets, length):
                edges = np.concatenate([begins, pasts[-1:]]) - begins[0]
                row, at, start, run, hashes = anchors(data[begins[0] : pasts[-1]], edges, length)
                row, keep = rows[row], stands[rows[row]]
                at = at - (offsets[row] - begins[0])
                start = start - (offsets[row] - begins[0])
                found.append((row[keep], (at << 2 * FIELD | at - start << FIELD | run)[keep], hashes[keep]))
            if not found:
                continue
            row, packed, hashes = map(np.concatenate, zip(*found))
            if not len(row):
                continue
            order = np.lexsort((packed, ids[row], hashes))
            owner, packed, hashes = ids[row][order], packed[order], hashes[order]
            key, travels, known = travel_keys(hashes, place_hashes(owner, packed))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(hashes.view(np.int64), mask=travels),
                    pa.array(owner),
                    pa.array(packed),
                    pa.array(known),
                ],
                ["key", "hash", "id", "packed", "known"],
            )

    return work


def place_hashes(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Tells anchors apart by text and place (not by run: a text worked on in parts may have an anchor twice)."""
    return mixed(mixed(ids.view(np.uint64)) + (packed >> 2 * FIELD).view(np.uint64))


def places(batch: pa.RecordBatch) -> np.ndarray:
    names = batch.schema.names
    return place_hashes(batch.column(names.index("id")).to_numpy(), batch.column(names.index("packed")).to_numpy())


def stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, ids, firsts, runs, stretches = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int64()) for x in (keys, ids, firsts, runs)), pa.array(stretches, pa.binary())],
        ["key", "id", "first", "run", "stretch"],
    )


def stretch_rows(length: int):
    """Rows (key, id, first, stretch) of the text around each remaining anchor.

    Of equal stretches in a batch the first is keyed by its anchor's hash; the others are repeats already and
    carry only their windows (run) under any key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int, bytes]] = set()
            rows: list[tuple] = []
            held = 0
            for k in np.argsort(batch.column(0).to_numpy(), kind="stable").tolist():
                owner = batch.column(0)[k].as_py()
                text = batch.column(1)[k].as_py().encode()
                for spot in sorted(batch.column(2)[k].as_py(), key=lambda s: s["packed"]):
                    at, back, run = spot["packed"] >> 2 * FIELD, spot["packed"] >> FIELD & LONGEST - 1, spot["packed"] & LONGEST - 1
                    first = at - back
                    stretch = text[first : first + run + length - 1]
                    which = (spot["hash"], back, stretch)
                    if which in seen:
                        rows.append((hash((owner, first)), owner, first, run, None))
                    else:
                        seen.add(which)
                        rows.append((spot["hash"], owner, first, run, stretch))
                        held += len(stretch)
                if held > STRETCHES_TOGETHER:
                    yield stretch_batch(rows)
                    seen.clear()
                    rows, held = [], 0
            yield stretch_batch(rows)

    return work


class Windows:
    """A suffix array: strings in byte order, each once, with its earliest place and its anchor hash."""

    def __init__(self, strings: np.ndarray, ids: np.ndarray, places: np.ndarray, keys: np.ndarray):
        self.strings, self.ids, self.places, self.keys = strings, ids, places, keys

    def __len__(self) -> int:
        return len(self.strings)

    def take(self, which: np.ndarray) -> Windows:
        return Windows(self.strings[which], self.ids[which], self.places[which], self.keys[which])

    @classmethod
    def build(cls, strings, ids, places, keys) -> tuple[Windows, np.ndarray, np.ndarray]:
        """The array of a batch, and the places (ids, places) of its own repeats."""
        order = np.lexsort((places, ids))
        order = order[np.argsort(strings[order], kind="stable")]
        ordered = cls(strings[order], ids[order], places[order], keys[order])
        first = np.ones(len(order), bool)
        first[1:] = ordered.strings[1:] != ordered.strings[:-1]
        return ordered.take(first), ordered.ids[~first], ordered.places[~first]

    def merged(self, other: Windows) -> Windows:
        """Both arrays as one; they share no string."""
        at = np.searchsorted(self.strings, other.strings) + np.arange(len(other))
        mine = np.ones(len(self) + len(other), bool)
        mine[at] = False

        def woven(a, b):
            out = np.empty(len(mine), a.dtype)
            out[mine], out[at] = a, b
            return out

        return Windows(*(woven(getattr(self, n), getattr(other, n)) for n in ("strings", "ids", "places", "keys")))


class Family:
    """Suffix arrays of growing size; adding one finds what repeats."""

    def __init__(self):
        self.levels: list[Windows] = []

    def add(self, new: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take in a batch's array; returns the (ids, places) that turned out to be repeats."""
        repeats = []
        for level in self.levels:
            if not len(new):
                break
            at = np.searchsorted(level.strings, new.strings).clip(max=len(level) - 1)
            hit = level.strings[at] == new.strings
            here = at[hit]
            later = (new.ids[hit] > level.ids[here]) | (
                (new.ids[hit] == level.ids[here]) & (new.places[hit] >= level.places[here])
            )
            repeats.append(
                (np.where(later, new.ids[hit], level.ids[here]), np.where(later, new.places[hit], level.places[here]))
            )
            level.ids[here] = np.where(later, level.ids[here], new.ids[hit])
            level.places[here] = np.where(later, level.places[here], new.places[hit])
            new = new.take(~hit)
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
        return repeats

    def forget(self, key: int) -> None:
        """Keep only strings of this anchor hash: no other comes again."""
        kept = [level.take(level.keys == key) for level in self.levels]
        self.levels = [level for level in kept if len(level)]


def as_runs(ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows (id, first, past) of consecutive places."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (places[1:] > places[:-1] + 1)] if len(ids) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(ids)] - 1 if len(ids) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[starts]), pa.array(places[starts]), pa.array(places[ends] + 1)], ["id", "first", "past"]
    )


def repeat_runs(length: int):
    """From rows (key, id, first, run, stretch) ordered by key, the runs of windows that repeat earlier ones."""

    def settle(held: list[pa.RecordBatch], family: Family) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys, ids = table["key"].to_numpy(), table["id"].to_numpy()
        firsts, runs = table["first"].to_numpy(), table["run"].to_numpy()
        stretches = table["stretch"].combine_chunks()
        known = stretches.is_null().to_numpy(zero_copy_only=False)
        repeats = []

        def windows_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = runs[which]
            begin = np.cumsum(counts) - counts
            inside = np.arange(counts.sum()) - np.repeat(begin, counts)
            return np.repeat(which, counts), inside

        rows, inside = windows_of(np.flatnonzero(known))
        repeats.append((ids[rows], firsts[rows] + inside))
        # A stretch alone with its key repeats nothing, unless more with the key have been or are to come.
        fresh = np.flatnonzero(~known)
        if len(fresh):
            _, group, counts = np.unique(keys[fresh], return_inverse=True, return_counts=True)
            met = (counts[group] > 1) | (keys[fresh] == keys[0]) | (keys[fresh] == keys[-1])
            fresh = fresh[met]
        if len(fresh):
            texts = stretches.take(pa.array(fresh))
            data = np.frombuffer(texts.cast(pa.large_binary()).buffers()[2], np.uint8)
            begins = np.cumsum(runs[fresh] + length - 1) - (runs[fresh] + length - 1)
            rows, inside = windows_of(fresh)
            starts = np.repeat(begins, runs[fresh]) + inside
            every = np.lib.stride_tricks.sliding_window_view(data, length)
            strings = np.ascontiguousarray(every[starts]).view(f"S{length}").ravel()
            array, again_ids, again_places = Windows.build(strings, ids[rows], firsts[rows] + inside, keys[rows])
            repeats.append((again_ids, again_places))
            repeats += family.add(array)
            family.forget(keys[-1])
        yield as_runs(*map(np.concatenate, zip(*repeats)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, waiting = Family(), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                held.append(part)
                waiting += pa.compute.sum(part.column(3)).as_py()
                if waiting >= WINDOWS_TOGETHER:
                    yield from settle(held, family)
                    held, waiting = [], 0
        if held:
            yield from settle(held, family)

    return work


def cut_out(length: int):
    """From rows (id, text, runs) the rows (id, n_removed, n_spans, kept): texts without their repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                at, gone, count, parts = 0, 0, 0, []
                end = -1  # of the removed run at hand
                for run in sorted((r["first"], r["past"]) for r in runs.as_py()):
                    first, past = run[0], run[1] + length - 1
                    if first > end:
                        count += 1
                        parts.append(data[max(at, 0) : first])
                    gone += max(0, past - max(first, end))
                    end = max(end, past)
                    at = end
                parts.append(data[at:])
                removed.append(gone)
                spans.append(count)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_removed", "n_spans", "kept"],
            )

    return work


def repeats_removed(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """All rows (id, n_bytes, sha, first), and (id, n_removed, n_spans, kept) of texts that lose bytes.

    ``first`` is the smallest id with the same text; kept bytes need not be valid UTF-8.
    """
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST} bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    nodes = cut(
        rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    )
    firsts = nodes.groupBy("sha").agg(F.min("id").alias("first"))
    found = rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length)).mapInArrow(
        anchor_rows(length), "key long, hash long, id long, packed long, known boolean"
    )
    stands = firsts.filter(F.col("first").isNotNull()).select(F.col("first").alias("id")).distinct()
    spots = cut(
        found.repartition("key")
        .sortWithinPartitions("key", "id", "packed")
        .mapInArrow(repeated_rows("key", "known", places), found.schema)
        .select(F.coalesce("hash", "key").alias("hash"), "id", "packed")
        .join(stands, "id", "left_semi")
        .distinct()
        .groupBy("id")
        .agg(F.collect_list(F.struct("hash", "packed")).alias("spots"))
    )
    # Both joins below take the texts from one shuffle.
    texts = likely(rows, spots, "id").join(spots.select("id").hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    stretches = texts.join(spots, "id").select("id", "text", "spots").mapInArrow(
        stretch_rows(length), "key long, id long, first long, run long, stretch binary"
    )
    runs = (
        stretches.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(repeat_runs(length), "id long, first long, past long")
        .groupBy("id")
        .agg(F.collect_list(F.struct("first", "past")).alias("runs"))
    )
    lost = texts.join(runs, "id").select("id", "text", "runs").mapInArrow(
        cut_out(length), "id long, n_removed long, n_spans long, kept binary"
    )
    return hub_join(nodes, firsts, "sha"), lost


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    nodes, lost = repeats_removed(docs, length, id_col, text_col)
    nothing = F.sha2(F.lit(""), 256)
    copy = (~F.col("id").eqNullSafe(F.col("first"))) & (F.col("n_bytes") >= length)
    lost = lost.select("id", "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept"))
    return nodes.join(lost, "id", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("_kept", "sha")).alias("kept_sha256"),
    )
