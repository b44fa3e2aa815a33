"""Exact Jaccard self-join of word n-gram sets, and its components, by skipping what set relations rule out.

A set's tokens (hashed five-word shingles) are put in one global order: the tokens that many documents hold
last, and otherwise by hash.  Two sets with Jaccard similarity of at least ``percent`` share a token among the
first n - ceil(percent * n) + 1 of either, so only those are posted to the inverted lists.  Three relations
between sets then save work, and none can lose a link:

* equal sets are one class, represented by its smallest id;
* a list is ordered by set size and by the token's position in the set, and entries of equal size and position are
  a cell: two sets share at most the lesser of the positions before the token and the lesser of the rests behind
  it, so cells that can't reach the threshold are skipped whole, and what follows too large a size at once;
* of the entries of other cells only pairs count whose 512-bit parity sketches are near enough (differing bits are
  a lower bound of differing tokens);
* a pair's number of lists and its last positions in them bound what it can share from above: behind the last
  common position nothing but the rest of either set is left;
* a set's answers are derived from those of a set found similar to it: first every set is tried against one
  partner only; sets linked that way share their answers, lists whose entries are all linked already are
  skipped whole, and elsewhere only pairs across components remain.  These are all tried, by the exact sets.

Lists longer than ``LIST_BLOCK`` are cut into blocks by classes of size and position and, within a class, by hash.
They are dealt as pairs of blocks, so no list is ever held whole; pairs whose classes can't reach the threshold by
the same bound, or hold one component only, are never dealt, and pairs inside a block are looked at in one part.  The order of
frequent tokens is a matter of speed alone; its table has at most ``FREQUENT`` tokens.

Null and empty texts and texts without a word have an empty set, no links and themselves as component.  A row
with a null id takes no part and has a null component.  Rows that repeat an id and text are one document.
An empty table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendcadence.llm.components import components, hub_join
from spendcadence.llm.repeats import repeated_rows, travel_keys
from spendcadence.llm.shared import cut, filled, fresh, likely, removed, written
from spendcadence.llm.shingles import mixed, shingle_sets

FREQUENT = 200_000  # tokens that come last in the order, at most
# Different sets of a batch, and summed over batches, from which a token counts as frequent.  By counting from two on, a token of
# f sets among B batches is missed only while f * f / B is small, so the pairs of such a list grow no faster than the input.
OFTEN_HERE, OFTEN = 2, 8
TOKENS_TOGETHER = 4_000_000  # tokens counted at once
SKETCH_BITS = 512
LIST_BLOCK = 512
POSITIONS = 16  # classes of a position, as parts of the set
PAIRS_TOGETHER = 1 << 19  # pairs of entries compared at once, unless two cells hold more
ROWS_TOGETHER = 50_000  # entries worked on at once, unless a list's blocks hold more


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of SKETCH_BITS buckets."""
    buckets = (mixed(tokens) >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def offsets_of(counts) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its set's size, digest and sketch; with a batch's first row, tokens that the batch holds often."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, digests, sketches, held, waiting, often, seen = [], [], [], [], 0, [], set()

        def count_held():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often.extend(zip(signed(tokens[counts >= OFTEN_HERE]).tolist(), counts[counts >= OFTEN_HERE].tolist()))
            held.clear()

        for tokens in shingle_sets(batch.column(1)):
            sizes.append(len(tokens))
            digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            sketches.append(sketch(tokens))
            if digests[-1] in seen:
                continue
            seen.add(digests[-1])
            held.append(tokens)
            waiting += len(tokens)
            if waiting > TOKENS_TOGETHER:
                count_held()
                waiting = 0
        if held:
            count_held()
        struct = pa.StructArray.from_arrays(
            [pa.array([t for t, _ in often], pa.int64()), pa.array([c for _, c in often], pa.int64())], ["token", "rows"]
        )
        lists = pa.ListArray.from_arrays(offsets_of([len(often)] + [0] * (batch.num_rows - 1)), struct)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(sketches, pa.binary()),
                lists,
            ],
            ["id", "n", "digest", "sketch", "often"],
        )


def prefix_size(n: int, percent: int) -> int:
    return n + (-n * percent) // 100 + 1


def poster(frequent: np.ndarray, percent: int):
    """Posts the prefix of every set, once for equal sets of a batch: rows (key, hash, id, at, known)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            first: dict[bytes, int] = {}
            prefixes: dict[bytes, np.ndarray] = {}
            for row, tokens in enumerate(shingle_sets(batch.column(1))):
                if not len(tokens):
                    continue
                key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if key in first:
                    if ids[row] < ids[first[key]]:
                        first[key] = row
                    continue
                first[key] = row
                if len(frequent):
                    at = np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)
                    last = frequent[at] == tokens
                    tokens = np.concatenate([tokens[~last], tokens[last]])
                prefixes[key] = tokens[: prefix_size(len(tokens), percent)].copy()
            if not first:
                continue
            counts = [len(p) for p in prefixes.values()]
            owners = np.repeat([first[key] for key in prefixes], counts)
            tokens = np.concatenate(list(prefixes.values()))
            at = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            order = np.lexsort((owners, tokens))
            tokens, owners, at = tokens[order], owners[order], at[order]
            key, travels, known = travel_keys(tokens, owners.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(key)),
                    pa.array(signed(tokens), mask=travels),
                    batch.column(0).take(pa.array(owners)),
                    pa.array(at),
                    pa.array(known),
                ],
                ["key", "hash", "id", "at", "known"],
            )

    return work


def owners(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row that differs from the row before where the id does."""
    ids = batch.column(batch.schema.names.index("id"))
    return ids.to_numpy(zero_copy_only=False)


def threshold(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of these summed sizes must share."""
    return -(-percent * sizes // (100 + percent))


def near_cells(lists, sizes, at, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of cells, each with itself too, of one list whose sets may be similar; ordered by list and size."""
    active = np.arange(len(lists))
    step = 0
    while len(active):
        active = active[active + step < len(lists)]
        # Sizes only grow along a list: once too large, the rest of the list is skipped.
        other = active + step
        active = active[(lists[other] == lists[active]) & (sizes[other] * percent <= sizes[active] * 100)]
        other = active + step
        most = np.minimum(at[active], at[other]) + np.minimum(sizes[active] - at[active], sizes[other] - at[other])
        good = most >= threshold(sizes[active] + sizes[other], percent)
        yield active[good], other[good]
        step += 1


def cell_entries(first, other, begin, count) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j), i < j, of entries of pairs of cells, some at a time."""
    many = count[first] * count[other]
    group = (np.cumsum(many) - many) // PAIRS_TOGETHER
    edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(many)]
    for low, high in zip(edges[:-1], edges[1:]):
        part = many[low:high]
        pair = np.repeat(np.arange(low, high), part)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(part) - part, part)
        i, j = np.divmod(at, count[other][pair])
        i, j = i + begin[first][pair], j + begin[other][pair]
        yield i[i < j], j[i < j]


def near_pairs(lists, sizes, at, sketches, labels, sides, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of entries of one list that may be similar and bear different labels.

    Entries come ordered by list, size and place ``at``.  Of a list that holds two blocks, told by ``sides`` other than 0,
    pairs across them alone are looked at.
    """
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = np.flatnonzero(np.r_[True, (np.diff(lists) != 0) | (np.diff(sizes) != 0) | (np.diff(at) != 0)])
    count = np.diff(np.r_[begin, len(lists)])
    for first, other in near_cells(lists[begin], sizes[begin], at[begin], percent):
        if not len(first):
            continue
        for i, j in cell_entries(first, other, begin, count):
            open_ = (labels[i] != labels[j]) & ((sides[i] != sides[j]) | (sides[i] == 0))
            i, j = i[open_], j[open_]
            both = sizes[i] + sizes[j]
            differing = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
            good = differing <= both - 2 * threshold(both, percent)
            found_i.append(i[good])
            found_j.append(j[good])
    return np.concatenate(found_i), np.concatenate(found_j)


def pair_finder(percent: int):
    """Rows (a, b, n_a, n_b, at_a, at_b) from entries (token, part, side, id, n, at, sketch, label) ordered by token, part, n, at."""

    def pairs(entries: pa.Table) -> pa.RecordBatch:
        token = entries["token"].to_numpy()
        part = entries["part"].to_numpy()
        new = np.r_[True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])]
        sketches = np.frombuffer(b"".join(entries["sketch"].to_pylist()), np.uint64).reshape(len(token), -1)
        labels = pa.compute.dictionary_encode(entries["label"].combine_chunks()).indices.to_numpy()
        n, at, side = (entries[name].to_numpy().astype(np.int64) for name in ("n", "at", "side"))
        i, j = near_pairs(np.cumsum(new), n, at, sketches, labels, side, percent)
        sides = [entries.select(["id", "n", "at"]).take(pa.array(k)).combine_chunks() for k in (i, j)]
        columns = [side[name].combine_chunks() for name in ("id", "n", "at") for side in sides]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n_a", "n_b", "at_a", "at_b"])

    return by_lists(pairs, ROWS_TOGETHER)


def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, none empty, in slices of about ``size`` bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def by_lists(pairs: Callable[[pa.Table], pa.RecordBatch], together: int, size: int = 1 << 40):
    """Hands ``pairs`` tables of whole lists from entries ordered by token and part, of about ``together`` rows or ``size`` bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in sliced(batches, size):
            held.append(batch)
            rows += batch.num_rows
            if rows < together and sum(b.nbytes for b in held) < size:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token, part = table["token"].to_numpy(), table["part"].to_numpy()
            same = (token == token[-1]) & (part == part[-1])
            whole = int(np.flatnonzero(same)[0])  # the last list may go on in the next batch
            if whole:
                yield pairs(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows = table.num_rows - whole
        if rows:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return work


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared), a > b, of the pairs (a, b, n_a, n_b, at_a, at_b; a row for each list) that may reach the threshold.

    ``shared`` lists held both sets; behind their last place in common at most the rest of the smaller can be shared.
    """
    swapped = F.col("a") < F.col("b")

    def side(one: str, other: str) -> Column:
        return F.when(swapped, F.col(other)).otherwise(F.col(one))

    names = [("a", "b"), ("b", "a"), ("n_a", "n_b"), ("n_b", "n_a"), ("at_a", "at_b"), ("at_b", "at_a")]
    counted = (
        pairs.select(*[side(one, other).alias(one) for one, other in names])
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    )
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    reach = (F.col("shared") + rest) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return counted.filter(reach).select("a", "b", "shared")


def first_partners(entries: DataFrame, percent: int) -> DataFrame:
    """For each set one other (a, b): the one it meets most often as the smallest id of a list."""
    least = entries.groupBy("token").agg(F.min(F.struct("id", "n", "at")).alias("_least"))
    met = hub_join(entries, least, "token").select(
        F.col("id").alias("a"), F.col("_least.id").alias("b"), F.col("n").alias("n_a"), F.col("_least.n").alias("n_b"),
        F.col("at").alias("at_a"), F.col("_least.at").alias("at_b"),
    )
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    found = possible(met.filter((F.col("a") != F.col("b")) & near), percent)
    return found.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def classes_of(entries: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """(token, _cells, _total): the classes of size and position of long lists, with their bounds and numbers of blocks.

    Sizes of a class differ by less than ``percent`` allows, so a list has a class for each such factor and each of a
    few positions, whatever its length.
    """
    cells = (
        hub_join(entries, long, "token")
        .groupBy("token", *size_and_position(percent))
        .agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.max("at").cast("long").alias("before"),
            F.max(F.col("n") - F.col("at")).alias("behind"),
            F.min("label").alias("least"),
            F.max("label").alias("most"),
            F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks"),
        )
    )
    earlier = Window.partitionBy("token").orderBy("s", "p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0).cast("long")))
    names = [c for c in cells.columns if c != "token"]
    return cells.groupBy("token").agg(F.collect_list(F.struct(*names)).alias("_cells"), F.sum("blocks").alias("_total"))


def size_and_position(percent: int) -> list[Column]:
    step = max(math.log(100 / percent), 0.01)
    return [F.floor(F.log("n") / step).alias("s"), F.floor(F.col("at") * POSITIONS / F.col("n")).alias("p")]


def dealt_lists(entries: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The entries (token, id, n, at, label) of lists that hold several labels, by parts, with the columns of ``nodes`` (id).

    ``side`` tells the two blocks of a part from each other; it is 0 where there is one.  The second table can go
    after the first is read.
    """
    lists = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("_size"),
        F.min("label").alias("_low"),
        F.max("label").alias("_high"),
        (F.min("n") * 100 >= F.max("n") * percent).alias("_near"),
    )
    # Lists of linked sets only are skipped whole, and so are two sets of sizes too different.
    lists = written(
        lists.filter((F.col("_low") != F.col("_high")) & ((F.col("_size") > 2) | F.col("_near"))).select("token", "_size")
    )
    long = lists.filter(F.col("_size") > LIST_BLOCK).select("token")
    known = lists.select("token").join(classes_of(entries, long, percent), "token", "left")
    # A class meets those classes of its list that hold sets similar to its own, as far as sizes and positions tell.
    near = f"""c.low * {percent} <= _mine.high * 100 AND _mine.low * {percent} <= c.high * 100
        AND (least(c.before, _mine.before) + least(c.behind, _mine.behind)) * {100 + percent} >= (c.low + _mine.low) * {percent}
        AND NOT (c.least = c.most AND _mine.least = c.least AND _mine.most = c.least)"""
    parts = f"""CASE WHEN _cells IS NULL THEN array(struct(0L AS part, 0 AS side))
        ELSE flatten(transform(filter(_cells, c -> {near}), c -> transform(sequence(c.first, c.first + c.blocks - 1),
            b -> struct(least(b, _own) * _total + greatest(b, _own) AS part, CAST(sign(b - _own) AS INT) AS side)))) END"""
    dealt = (
        hub_join(entries, known, "token")
        .join(nodes, "id")
        .select("*", *size_and_position(percent))
        .withColumn("_mine", F.expr("get(filter(_cells, c -> c.s = s AND c.p = p), 0)"))
        .withColumn("_own", F.expr("_mine.first + pmod(xxhash64(id), _mine.blocks)"))
        .select("token", "id", "n", "at", "label", *[c for c in nodes.columns if c != "id"], F.inline(F.expr(parts)))
    )
    return dealt, lists


def remaining_pairs(entries: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a > b, of entries (token, id, n, at, label) that may be linked and differ in label.

    The second table can go after the first is read.
    """
    dealt, lists = dealt_lists(entries, nodes.select("id", "sketch"), percent)
    kind = entries.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("a", kind), T.StructField("b", kind)]
        + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b")]
        + [T.StructField(c, T.IntegerType()) for c in ("at_a", "at_b")]
    )
    found = (
        dealt.repartition("token", "part")
        .sortWithinPartitions("token", "part", "n", "at", "id")
        .mapInArrow(pair_finder(percent), schema)
    )
    return possible(found, percent).select("a", "b"), lists


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact sets reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            sides = []
            for name in ("_text_a", "_text_b"):
                coded = batch.column(names.index(name)).dictionary_encode()
                sets = list(shingle_sets(coded.dictionary))
                sides.append([sets[k] for k in coded.indices.to_numpy()])
            good = []
            for x, y in zip(*sides):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("a")).filter(keep), batch.column(names.index("b")).filter(keep)], ["a", "b"]
            )

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = written(likely(rows, wanted, "id").join(wanted.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]))
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_text_b")), "b")
    good = written(both.select("a", "b", "_text_a", "_text_b").mapInArrow(work, pairs.schema))
    removed(texts)
    return good


def components_of(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row."""
    rows = docs.select(F.col(id_col).alias("id"), filled(text_col).alias("text"))
    kind = rows.schema["id"]
    nodes = cut(
        rows.mapInArrow(
            described,
            T.StructType(
                [
                    kind,
                    T.StructField("n", T.LongType()),
                    T.StructField("digest", T.BinaryType()),
                    T.StructField("sketch", T.BinaryType()),
                    T.StructField("often", T.ArrayType(T.StructType().add("token", "long").add("rows", "long"))),
                ]
            ),
        )
    )
    frequent = (
        nodes.select(F.inline("often"))
        .groupBy("token")
        .agg(F.sum("rows").alias("rows"))
        .filter(F.col("rows") >= OFTEN)
        .orderBy(F.desc("rows"), "token")
        .limit(FREQUENT)
    )
    late = np.sort(np.array([r["token"] for r in frequent.collect()], np.int64).view(np.uint64))

    # The smallest id of equal sets stands for them.
    some = F.col("id").isNotNull()
    firsts = nodes.filter(some & (F.col("n") > 0)).groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    firsts = cut(firsts.select("id", "n", "sketch"))

    # Inverted lists of the tokens that more than one of them posts.
    posted = rows.filter(some).mapInArrow(
        poster(late, percent),
        T.StructType(
            [
                T.StructField("key", T.LongType()),
                T.StructField("hash", T.LongType()),
                kind,
                T.StructField("at", T.IntegerType()),
                T.StructField("known", T.BooleanType()),
            ]
        ),
    )
    lists = written(
        posted.repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(repeated_rows("key", "known", owners), posted.schema)
        .select(F.coalesce("hash", "key").alias("token"), "id", "at")
        .join(firsts.select("id", "n"), "id")
    )

    # One partner for each set, then what is left across components.
    one = written(first_partners(lists, percent))
    links = verified(one, rows, percent)
    found = components(links)
    labelled = lists.join(found.select(F.col("a").alias("id"), F.col("b").alias("_least")), "id", "left").withColumn(
        "label", F.coalesce("_least", "id")
    )
    rest, dealt = remaining_pairs(labelled.drop("_least"), firsts, percent)
    rest = written(rest.join(one, ["a", "b"], "left_anti"))
    removed(lists, one, found, dealt)
    more = verified(rest, rows, percent)
    found = components(links.union(more))
    removed(rest, links, more)

    # Classes of equal sets, and the component of each class.
    classes = (
        nodes.filter("n > 0 AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("_class"))
        .join(found.select(F.col("a").alias("_class"), F.col("b").alias("_least")), "_class", "left")
        .select("digest", F.coalesce("_least", "_class").alias("_component"))
    )
    again = F.xxhash64("digest")
    return (
        nodes.withColumn("_again", again)
        .join(classes.withColumn("_again", again), ["digest", "_again"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("_component")).alias("component_id"),
        )
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: of each component the document with the smallest id; rows without an id stay."""
    found = components_of(docs, percent, id_col, text_col)
    name = fresh(docs, "_going")
    going = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(going.hint("shuffle_hash"), docs[id_col] == going[name], "left_anti")
