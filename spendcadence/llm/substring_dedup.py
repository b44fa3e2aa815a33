"""Removal of repeated paragraphs by MinHash banding.

Two kinds of paragraph are looked at.

* A line of at least five words.  Its five-word shingles give a MinHash signature of ``BANDS`` bands of
  ``ROWS`` values; lines that collide in a band are candidates, and those whose exact Jaccard similarity reaches
  ``percent`` are linked (at a similarity of 0.8 a pair shares a band with a probability of 0.986).  Lines of equal
  words (by a 64-bit hash of them) are one node.  Every line is first tried against the smallest of its band's bucket, then all pairs of a bucket
  that are not linked yet are judged, by sizes and sketches first and by the exact sets last.  Of each connected component the line that comes first stays, the others go.
* A passage of ``LEAST_WORDS`` words, wherever it stands in what those lines leave.  Of the runs of ``SEED`` words in
  a passage the one of least hash is its seed, so equal passages have equal seeds; only passages whose seed repeats
  are looked at, and they collide if all their words are equal (by a 64-bit hash of them).  The first occurrence stays; the words of the
  others go, unless it overlaps them.  A passage whose words recur after at most ``PERIOD`` words is no repeat of one in
  the same document.

First is by id, then by place.  Nothing is gathered by key: smallest members are found by pre-aggregation, buckets are
dealt as pairs of blocks, and hot keys are split (see :mod:`spendcadence.llm.repeats` and ``hub_join``).

Words are those of :mod:`spendcadence.llm.shingles`.  What goes is cut together with the white space that follows
it; a text may become empty but its row stays.  Null text stays null.  Rows with a null id keep their text and are no
one's first.  Rows that repeat an id and text are one document and lose the same.  Ids are integers.  An empty table
gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.components import components, hub_join
from spendcadence.llm.ngram_join import by_lists, dealt_lists, near_pairs, sketch, sliced
from spendcadence.llm.repeats import repeated_rows, travel_keys
from spendcadence.llm.shared import fresh, likely, removed, written
from spendcadence.llm.shingles import BASE, INVERSE, PLACE, WHITE, WIDTH, blocks, buffers, mixed, powers, shingle_sets, word_hashes

LEAST_WORDS = 20
BANDS, ROWS = 6, 3
LINES_TOGETHER, LINE_BYTES = 4096, 4 << 20  # colliding lines judged at once, unless a bucket's blocks hold more
TEXT_BYTES = 8 << 20  # of texts worked on at once, unless one is longer
SEED = 8  # words
PERIOD = 4  # words
SPAN = 31  # bits of a paragraph's length in bytes; the rest of a long is where it begins
EMPTY = np.zeros(0, np.int64)


def row_edges(row: np.ndarray) -> np.ndarray:
    return np.r_[True, row[1:] != row[:-1]]


def line_bands(data, words, starts, row):
    """For lines of enough words: (first word, past word, content hash, band keys)."""
    line = np.cumsum(data == 0x0A)[starts]
    new = row_edges(row) | row_edges(line)
    first = np.flatnonzero(new)
    past = np.r_[first[1:], len(words)]
    long_enough = past - first >= WIDTH
    first, past = first[long_enough], past[long_enough]
    if not len(first):
        return first, past, np.zeros(0, np.uint64), np.zeros((BANDS, 0), np.uint64)
    shingles = words[: len(words) - WIDTH + 1] * PLACE[0]
    for k in range(1, WIDTH):
        shingles += words[k : k + len(shingles)] * PLACE[k]
    shingles = mixed(shingles)
    counts = past - first - WIDTH + 1
    begin = np.cumsum(counts) - counts
    own = shingles[np.repeat(first - begin, counts) + np.arange(counts.sum())]
    keys = []
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(mixed(own ^ PLACE[k + 8]), begin)
            key = mixed(key * PLACE[1] + least)
        keys.append(key)
    return first, past, content_hashes(words, first, past), np.stack(keys)


def content_hashes(words: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hash of the words of each range."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mixed((sums[past] - sums[first]) * powers(INVERSE, len(words) + 1)[first] + (past - first).astype(np.uint64))


def seeds(words, row) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the passages inside a row, and of the seed of each."""
    places = len(words) - LEAST_WORDS + 1
    if places <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(len(words) - SEED + 1)
    rank = mixed(content_hashes(words, first, first + SEED))
    least = np.lib.stride_tricks.sliding_window_view(rank, LEAST_WORDS - SEED + 1).argmin(axis=1)
    whole = np.flatnonzero(row[:places] == row[LEAST_WORDS - 1 :])
    return whole, whole + least[whole]


def past_bytes(starts, row, begin, end):
    """A paragraph's bytes reach to the next word, or to the end of the text."""
    following = np.r_[starts[1:], 0]
    last = np.r_[row[1:] != row[:-1], True]
    following[last] = end[row[last]]
    return following


def paragraph_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, hash, content, id, packed, known): the bands of lines (with content) and seeds (without)."""
    for batch in sliced(batches, TEXT_BYTES):
        ids = batch.column(0).to_numpy()
        data, offsets = buffers(batch.column(1))
        found = []
        for low, high in blocks(offsets):
            part = data[offsets[low] : offsets[high]]
            words, starts, stops, row = word_hashes(part, offsets[low : high + 1] - offsets[low])
            if not len(words):
                continue
            begin = offsets[low:high] - offsets[low]
            following = past_bytes(starts, row, begin, offsets[low + 1 : high + 1] - offsets[low])

            def packed(first, past):
                at = starts[first] - begin[row[first]]
                return at << SPAN | (following[past - 1] - starts[first])

            first, past, content, keys = line_bands(part, words, starts, row)
            for key in keys:
                found.append((key, content, np.ones(len(first), bool), row[first] + low, packed(first, past)))
            first = np.unique(seeds(words, row)[1])
            past = first + SEED
            content = content_hashes(words, first, past)
            found.append((content, content, np.zeros(len(first), bool), row[first] + low, packed(first, past)))
        if not found:
            continue
        keys, content, is_line, row, spans = map(np.concatenate, zip(*found))
        if not len(keys):
            continue
        places = place_hashes(ids[row], spans)
        order = np.lexsort((places, spans, ids[row], keys))
        keys, content, is_line, row, spans, places = (x[order] for x in (keys, content, is_line, row, spans, places))
        travel, travels, known = travel_keys(keys, places)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(travel.view(np.int64)),
                pa.array(keys.view(np.int64), mask=travels),
                pa.array(content.view(np.int64), mask=~is_line),
                pa.array(ids[row]),
                pa.array(spans),
                pa.array(known),
            ],
            ["key", "hash", "content", "id", "packed", "known"],
        )


def place_hashes(ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.astype(np.int64).view(np.uint64)) + spans.astype(np.int64).view(np.uint64))


def places(batch: pa.RecordBatch) -> np.ndarray:
    names = batch.schema.names
    return place_hashes(batch.column(names.index("id")).to_numpy(), batch.column(names.index("packed")).to_numpy())


def similar_lines(percent: int):
    """The pairs (a, b) of rows (a, b, _text_a, _text_b) whose exact shingle sets reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TEXT_BYTES):
            good = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return work


def line_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n): the set size of each row (content, line)."""
    for batch in batches:
        sizes = [len(tokens) for tokens in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n"])


def linker(percent: int):
    """Pairs (a, b) that link all similar entries (token, part, side, id, n, label, line) of a list, ordered by token, part, n.

    Every pair of different labels is judged by its exact sets unless pairs found before link it already, so a list
    gives fewer pairs than it has entries.
    """

    def pairs(entries: pa.Table) -> pa.RecordBatch:
        token, part = entries["token"].to_numpy(), entries["part"].to_numpy()
        new = np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])]
        coded = entries["line"].combine_chunks().dictionary_encode()
        sets = list(shingle_sets(coded.dictionary))
        which = coded.indices.to_numpy()
        sketches = np.frombuffer(b"".join(sketch(x) for x in sets), np.uint64).reshape(len(sets), -1)[which]
        labels = pa.compute.dictionary_encode(entries["label"].combine_chunks()).indices.to_numpy()
        n, side = (entries[name].to_numpy().astype(np.int64) for name in ("n", "side"))
        found = near_pairs(np.cumsum(new), n, np.zeros(len(n), np.int64), sketches, labels, side, percent)
        leader = list(range(int(labels.max()) + 1))

        def top(x: int) -> int:
            while leader[x] != x:
                leader[x] = x = leader[leader[x]]
            return x

        good = []
        for i, j in zip(*(side.tolist() for side in found)):
            a, b = top(labels[i]), top(labels[j])
            if a == b:
                continue
            x, y = sets[which[i]], sets[which[j]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                leader[a] = b
                good.append((i, j))
        ids = entries["id"].to_numpy()
        i, j = np.array(good, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64())], ["a", "b"])

    return by_lists(pairs, LINES_TOGETHER, LINE_BYTES)


def line_links(links: DataFrame, contents: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The similar pairs (a, b) that connect all similar pairs of a bucket, and tables that can go after they are read.

    ``links`` are pairs to try first, ``contents`` (key, content) the buckets, ``texts`` (content, line) the lines.
    """

    def judged(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("content").alias("a"), F.col("line").alias("_text_a")), "a")
        both = with_a.join(texts.select(F.col("content").alias("b"), F.col("line").alias("_text_b")), "b")
        return both.select("a", "b", "_text_a", "_text_b").mapInArrow(similar_lines(percent), "a long, b long")

    one = written(judged(links))
    removed(links)
    linked = components(one).select(F.col("a").alias("id"), F.col("b").alias("_to"))
    sizes = written(texts.select("content", "line").mapInArrow(line_sizes, "id long, n long"))
    entries = (
        contents.select(F.col("key").alias("token"), F.col("content").alias("id"))
        .join(sizes, "id")
        .join(linked, "id", "left")
        .select("token", "id", "n", F.lit(0).alias("at"), F.coalesce("_to", "id").alias("label"))
    )
    dealt, lists = dealt_lists(entries, texts.select(F.col("content").alias("id"), "line"), percent)
    rest = (
        dealt.select("token", "part", "side", "id", "n", "label", "line")
        .repartition("token", "part")
        .sortWithinPartitions("token", "part", "n", "id")
        .mapInArrow(linker(percent), "a long, b long")
    )
    return one.union(rest), [one, sizes, lists]


def marks_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first bytes of a row's seeds, and the first and past bytes of its lines that go."""
    values = column[k].values
    at, size = values.field("at").to_numpy(), values.field("size").to_numpy()
    line = size > 0
    return at[~line], at[line], at[line] + size[line]


def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, marks) with a seed outside the lines that go."""
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):
            seed, first, past = marks_of(batch.column(1), k)
            first.sort()
            past.sort()
            keep.append(bool(((np.searchsorted(first, seed, "right") == np.searchsorted(past, seed, "right"))).any()))
        yield batch.filter(pa.array(keep, pa.bool_()))


def all_of(good: np.ndarray, count: int, size: int) -> np.ndarray:
    """For the first ``count`` places whether ``size`` places from there on are good."""
    sums = np.r_[0, np.cumsum(good)]
    return sums[size : size + count] - sums[:count] == size


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, packed, periodic, known) of passages whose seeds repeat, from rows (id, text, marks).

    Of equal passages of a batch the first travels under its hash; the others are known to go, neighbours as one span.
    """
    for batch in sliced(batches, TEXT_BYTES):
        ids = batch.column(0).to_numpy()
        data, offsets = buffers(batch.column(1))
        keys, rows, spans, order, regular = [], [], [], [], []
        for low, high in blocks(offsets):
            part = data[offsets[low] : offsets[high]]
            words, starts, _, row = word_hashes(part, offsets[low : high + 1] - offsets[low])
            count = len(words) - LEAST_WORDS + 1
            if count <= 0:
                continue
            begin, end = offsets[low:high] - offsets[low], offsets[low + 1 : high + 1] - offsets[low]
            following = past_bytes(starts, row, begin, end)
            seed_at, firsts, pasts = [], [], []
            for k in range(high - low):
                for held, found in zip((seed_at, firsts, pasts), marks_of(batch.column(2), low + k)):
                    held.append(found + begin[k])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.searchsorted(starts, np.concatenate(firsts)), 1)
            np.add.at(change, np.searchsorted(starts, np.concatenate(pasts)), -1)
            first, seed = seeds(words, row)
            stays = all_of(np.cumsum(change[:-1]) == 0, count, LEAST_WORDS)
            first = first[np.isin(starts[seed], np.concatenate(seed_at)) & stays[first]]
            periodic = np.zeros(count, bool)
            for step in range(1, PERIOD + 1):
                periodic |= all_of(words[step:] == words[:-step], count, LEAST_WORDS - step)
            keys.append(content_hashes(words, first, first + LEAST_WORDS))
            rows.append(row[first] + low)
            spans.append((starts[first] - begin[row[first]]) << SPAN | (following[first + LEAST_WORDS - 1] - starts[first]))
            order.append(first)
            regular.append(periodic[first])
        if not keys or not sum(map(len, keys)):
            continue
        keys, rows, spans, order, periodic = map(np.concatenate, (keys, rows, spans, order, regular))
        sort = np.lexsort((spans, ids[rows], keys))
        new = np.r_[True, keys[sort][1:] != keys[sort][:-1]]
        least = np.empty(len(sort), np.int64)
        least[sort] = sort[np.flatnonzero(new)[np.cumsum(new) - 1]]
        known = is_later(ids[rows], spans, periodic, ids[rows][least], past_of(spans)[least])
        at = np.flatnonzero(known)
        joined = np.r_[False, (rows[at][1:] == rows[at][:-1]) & (order[at][1:] <= order[at][:-1] + LEAST_WORDS)][: len(at)]
        head, tail = at[~joined], at[np.r_[~joined[1:], True][: len(at)]]
        merged = (spans[head] >> SPAN) << SPAN | (past_of(spans)[tail] - (spans[head] >> SPAN))
        travel = np.flatnonzero(~known)
        places = place_hashes(ids[rows[head]], merged)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[keys[travel], places].view(np.int64)),
                pa.array(ids[np.r_[rows[travel], rows[head]]]),
                pa.array(np.r_[spans[travel], merged]),
                pa.array(np.r_[periodic[travel], np.zeros(len(head), bool)]),
                pa.array(np.r_[np.zeros(len(travel), bool), np.ones(len(head), bool)]),
            ],
            ["key", "id", "packed", "periodic", "known"],
        )


def past_of(spans: np.ndarray) -> np.ndarray:
    return (spans >> SPAN) + (spans & ((1 << SPAN) - 1))


def is_later(ids, spans, periodic, first_ids, first_pasts) -> np.ndarray:
    """Whether passages go, given where the first of their equals stands."""
    return (ids != first_ids) | (~periodic & (spans >> SPAN >= first_pasts))


def later_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, packed) of the rows that go, of rows ordered by known, key, id, packed."""
    held = None  # key, id and past byte of the first passage of the last key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, spans = (batch.column(k).to_numpy() for k in range(3))
        periodic, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        new = np.r_[held is None or key[0] != held[0], key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first_ids, first_pasts = ids[at], past_of(spans)[at]
        if held is not None:
            first_ids[at < 0], first_pasts[at < 0] = held[1:]
        going = known | is_later(ids, spans, periodic, first_ids, first_pasts)
        held = key[-1], first_ids[-1], first_pasts[-1]
        yield batch.filter(pa.array(going)).select(["id", "packed"])


def taken_out(text: str, spans: list[dict]) -> str:
    """The text without its repeated lines and passages."""
    data = text.encode()
    at, kept = 0, []
    for first, past in sorted((s["first"], s["past"]) for s in spans):
        if first > at:
            kept.append(data[at:first])
        at = max(at, past)
    kept.append(data[at:])
    return b"".join(kept).decode()


def cutter(text_at: int, spans_at: int, removed_col: str):
    """Puts the remaining text in place of the text, and the bytes removed in place of the spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(text_at).to_pylist(), [0] * batch.num_rows
            touched = np.flatnonzero(batch.column(spans_at).is_valid().to_numpy(zero_copy_only=False))
            for k in touched.tolist():
                if texts[k] is None:
                    continue
                left = taken_out(texts[k], batch.column(spans_at)[k].as_py())
                removed[k] = len(texts[k].encode()) - len(left.encode())
                texts[k] = left
            columns = list(batch.columns)
            columns[text_at], columns[spans_at] = pa.array(texts, pa.string()), pa.array(removed, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:spans_at], removed_col])

    return work


def smallest(name: str) -> Column:
    return F.min(F.struct("id", "packed")).alias(name)


def repeated_spans(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_id and its repeated paragraphs, _spans: array of (first, past)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.octet_length("text") > 0)
    )
    found = rows.mapInArrow(
        paragraph_rows, "key long, hash long, content long, id long, packed long, known boolean"
    )
    repeated = written(
        found.repartition("key")
        .sortWithinPartitions("key", "id", "packed")
        .mapInArrow(repeated_rows("key", "known", places), found.schema)
        .select(F.coalesce("hash", "key").alias("key"), "content", "id", "packed")
        .distinct()
    )
    # Lines: nodes are contents; a band tries its contents against the smallest of them first.
    bands = repeated.filter("content IS NOT NULL")
    lines = bands.select("content", "id", "packed").distinct()
    contents = bands.select("key", "content").distinct()
    links = (
        hub_join(contents, contents.groupBy("key").agg(F.min("content").alias("b")), "key")
        .filter("content <> b")
        .select(F.col("content").alias("a"), "b")
        .distinct()
    )
    links = written(links)
    wanted = links.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    # The first of each line is found before the join: a line may stand at very many places.
    shown = lines.groupBy("content").agg(smallest("_first")).select("content", "_first.*").join(wanted, "content", "left_semi")
    span = F.pmod("packed", F.lit(1 << SPAN)).cast("int")
    texts = (
        likely(rows, shown, "id")
        .join(shown.hint("shuffle_hash"), "id")
        .select(
            "content",
            F.substring(F.encode("text", "UTF-8"), (F.shiftright("packed", SPAN) + 1).cast("int"), span)
            .cast("string")
            .alias("line"),
        )
        .dropDuplicates(["content"])
    )
    texts = written(texts)
    found, read = line_links(links, contents, texts, percent)
    clusters = components(found)
    removed(texts, *read)
    named = lines.join(clusters.select(F.col("a").alias("content"), F.col("b").alias("_to")), "content", "left").select(
        F.coalesce("_to", "content").alias("cluster"), "id", "packed"
    )
    going = hub_join(named, named.groupBy("cluster").agg(smallest("_first")), "cluster").filter(
        F.struct("id", "packed") != F.col("_first")
    )
    going = written(going.select("id", "packed"))
    removed(clusters)

    # Passages in what is left: texts that hold repeated seeds outside the lines that go.
    first, size = F.shiftright("packed", SPAN), F.pmod("packed", F.lit(1 << SPAN))
    marks = (
        repeated.filter("content IS NULL")
        .select("id", first.alias("at"), F.lit(0).cast("long").alias("size"))
        .union(going.select("id", first, size))
        .groupBy("id")
        .agg(F.collect_list(F.struct("at", "size")).alias("_marks"))
    )
    marks = written(marks.mapInArrow(open_rows, marks.schema))
    removed(repeated)
    again = (
        likely(rows, marks, "id")
        .join(marks.hint("shuffle_hash"), "id")
        .select("id", "text", "_marks")
        .mapInArrow(passage_rows, "key long, id long, packed long, periodic boolean, known boolean")
        .repartition("key")
        .sortWithinPartitions("known", "key", "id", "packed")
        .mapInArrow(later_passages, "id long, packed long")
    )
    return going.union(again).groupBy(F.col("id").alias("_id")).agg(
        F.collect_list(F.struct(first.alias("first"), (first + size).alias("past"))).alias("_spans")
    )


def remove_repeats(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed"
) -> DataFrame:
    """The rows with their repeated paragraphs cut out of the text, and the bytes removed as ``removed_col``."""
    rows = docs.drop(removed_col)
    columns = rows.columns
    owner = fresh(rows, "_id")
    spans = fresh(rows, "_spans")
    found = repeated_spans(docs, percent, id_col, text_col).toDF(owner, spans)
    joined = rows.join(found, rows[id_col].cast("long") == found[owner], "left").select(*columns, spans)
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField(removed_col, T.LongType())])
    return joined.mapInArrow(cutter(columns.index(text_col), len(columns), removed_col), schema)


def recounted(rows: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows with their number of characters set anew, where they carry one."""
    if count_col not in rows.columns:
        return rows
    return rows.withColumn(count_col, F.length(text_col).cast(rows.schema[count_col].dataType))
