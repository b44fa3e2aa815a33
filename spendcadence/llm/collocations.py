"""Phrase collocations, counted in suffix subtrees that are built group by group within a memory budget.

All is per language (null counts as ``und``).  Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and
those into words at spaces and tabs.

1. Words are counted, and pairs of words by their hashes.  Words and pairs seen fewer than ``least`` times are in no phrase
   that counts, so suffixes end before them.
2. Vertical partitioning: the suffixes of the text (three words deep, as no phrase is longer) are told apart by their
   first word; where that word begins more than ``HEAVY`` suffixes, by their first two words; and where those begin more,
   by all three.  Prefixes are put in groups of about ``BUDGET`` suffixes each.
3. Every group builds its depth-truncated suffix subtree on its own: its suffixes in order, with the places where they
   part from each other at depth two and three.  A phrase's count is the total of the leaves below it.  Groups are worked
   off one after the other, so a task holds one of them.
4. Joins bring the counts of the parts of a phrase; scores are exact decimals.

Suffixes are counted within a batch before they travel.  Which words and pairs are rare, and which prefixes heavy, is told
by bitmaps of fixed size over 64-bit hashes: where hashes collide, a rare one is kept or a light prefix divided, which
changes no count.  Within a batch words are told apart by 64-bit hashes, beyond it by their bytes.

Null and empty texts hold no words.  Every row counts, rows that repeat an id included, as does one with a null id; ids
aren't read.  An empty table gives an empty result.  Columns besides text and language are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcadence.llm.components import hub_join
from spendcadence.llm.shared import BITMAP, BITS, filled, given_back, written
from spendcadence.llm.shingles import blocks, buffers, mixed, word_hashes

BUDGET = 400_000  # suffixes of a group
HEAVY = BUDGET // 8
TOGETHER = 4 << 20  # bytes of text whose suffixes are counted at once, unless one is longer
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WHITE = BREAKS.copy()
WHITE[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SECOND = np.uint64(0x9E3779B97F4A7C15)


def language_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Words:
    """The words of some texts: ``code`` of each, whether the word behind is of its piece, and the different words.

    ``key`` hashes a word and its language; ``lang`` is the language's number in ``langs``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row_lang: np.ndarray, langs: list[str]):
        keys, spans, joined = [], [], []
        salts = np.array([language_key(x) for x in langs], np.uint64)
        for low, high in blocks(offsets):
            part = data[offsets[low] : offsets[high]]
            hashes, starts, stops, row = word_hashes(part, offsets[low : high + 1] - offsets[low], WHITE)
            if not len(hashes):
                continue
            cuts = np.cumsum(BREAKS[part])[starts]
            joined.append(np.r_[(row[1:] == row[:-1]) & (cuts[1:] == cuts[:-1]), False])
            keys.append(mixed(hashes ^ salts[row_lang[row + low]]))
            spans.append(np.stack([starts + offsets[low], stops + offsets[low], row_lang[row + low]]))
        self.size = sum(map(len, keys))
        if not self.size:
            return
        self.joined = np.concatenate(joined)
        self.key, first, self.code, self.count = np.unique(
            np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True
        )
        starts, stops, self.lang = np.concatenate(spans, axis=1)[:, first]
        sizes = stops - starts
        ends = np.cumsum(sizes)
        letters = LOWER[data[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]]
        edges = np.r_[0, ends].astype(np.int32)
        self.word = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(edges), pa.py_buffer(letters))


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Of batches (lang, text), the words and languages of about TOGETHER bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        row_lang, langs = coded.indices.to_numpy(), coded.dictionary
        data, offsets = buffers(batch.column(1))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + TOGETHER, "right")) - 1)
            found = Words(data, offsets[low : high + 1], row_lang[low:high], langs.to_pylist())
            if found.size:
                yield found, langs
            low = high


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n) of the words of each batch."""
    for found, langs in words_of(batches):
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(found.lang)), found.word, pa.array(found.key.view(np.int64)), pa.array(found.count)],
            ["lang", "word", "key", "n"],
        )


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(BITS - 1)
    return bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``: 4 MB in at most BITS / BITMAP rows, whatever the table's size."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    rows = keys.groupBy(F.shiftright(bit, 15).alias("row")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(BITMAP))).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():
        out[r["row"] * BITMAP // 8 : (r["row"] + 1) * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * SECOND + second)


def batch_pairs(found: Words, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of the neighbouring frequent words of a batch, which of these pairs each place begins (or -1), and counts."""
    known = has(frequent, found.key)[found.code]
    at = np.flatnonzero(known & found.joined & np.r_[known[1:], False])
    width = len(found.key)
    pairs, which, counts = np.unique(found.code[at] * width + found.code[at + 1], return_inverse=True, return_counts=True)
    begins = np.full(found.size, -1)
    begins[at] = which
    return pairs // width, pairs % width, begins, counts


def pair_rows(frequent):
    """(key, n) of the pairs of frequent words of each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in words_of(batches):
            one, two, _, counts = batch_pairs(found, frequent.value)
            keys = pair_keys(found.key[one], found.key[two])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    return work


def suffix_rows(bitmaps, groups: int):
    """(group, whole, lang, w1, w2, w3, n): the suffixes of a batch; ``whole`` if all of their pair meet in the group.

    ``bitmaps`` tell frequent words, frequent pairs, heavy words and heavy pairs.  A suffix ends before a rare pair.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often, heavy, heavier = bitmaps.value
        for found, langs in words_of(batches):
            one, two, begins, _ = batch_pairs(found, words)
            keys = pair_keys(found.key[one], found.key[two])
            kept = np.r_[has(often, keys), False]  # the last stands for -1
            begins = np.where(kept[begins], begins, -1)
            at = np.flatnonzero(begins >= 0)
            if not len(at):
                continue
            behind = begins[np.minimum(at + 1, found.size - 1)]
            third = np.where((behind >= 0) & (at + 1 < found.size), np.r_[two, -1][behind], -1)
            width = len(found.key) + 1
            leaves, counts = np.unique(begins[at] * width + third + 1, return_counts=True)
            pair, three = leaves // width, leaves % width - 1
            one, two, pair_key = one[pair], two[pair], keys[pair]
            third_key = np.where(three >= 0, found.key[three], SECOND)
            divided = has(heavy, found.key[one])
            again = divided & has(heavier, pair_key)
            prefix = np.where(again, pair_keys(pair_key, third_key), np.where(divided, pair_key, found.key[one]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((mixed(prefix + SECOND) % np.uint64(groups)).astype(np.int64)),
                    pa.array(~again),
                    langs.take(pa.array(found.lang[one])),
                    found.word.take(pa.array(one)),
                    found.word.take(pa.array(two)),
                    found.word.take(pa.array(three, mask=three < 0)),
                    pa.array(counts),
                ],
                ["group", "whole", "lang", "w1", "w2", "w3", "n"],
            )

    return work


def subtree(leaves: pa.Table, least: int) -> pa.RecordBatch:
    """(whole, lang, w1, w2, w3, n): the phrases of two words (w3 null) and three that a group's leaves count often enough.

    Pairs whose suffixes lie in several groups come with what this group has of them.
    """
    names = ["lang", "w1", "w2", "w3"]
    coded = [leaves[x].combine_chunks().dictionary_encode() for x in names]
    codes = [c.indices.fill_null(-1).to_numpy() for c in coded]
    order = np.lexsort(codes[::-1])
    codes = [c[order] for c in codes]
    counts = leaves["n"].to_numpy()[order]
    parts = np.zeros(len(order), bool)
    parts[0] = True
    for c in codes[:3]:
        parts[1:] |= c[1:] != c[:-1]
    pairs = np.flatnonzero(parts)
    parts[1:] |= codes[3][1:] != codes[3][:-1]
    triples = np.flatnonzero(parts)
    pair_counts, triple_counts = np.add.reduceat(counts, pairs), np.add.reduceat(counts, triples)
    whole = leaves["whole"].to_numpy()[order]
    counts_here = ~whole[pairs] | (pair_counts >= least)
    pairs, pair_counts = pairs[counts_here], pair_counts[counts_here]
    often = (triple_counts >= least) & (codes[3][triples] >= 0)
    triples, triple_counts = triples[often], triple_counts[often]
    at = np.r_[pairs, triples]
    columns = [
        c.dictionary.take(pa.array(code[at], mask=(np.arange(len(at)) < len(pairs)) if name == "w3" else None))
        for name, c, code in zip(names, coded, codes)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(whole[at]), *columns, pa.array(np.r_[pair_counts, triple_counts])], ["whole", *names, "n"]
    )


def subtrees(least: int):
    """Subtrees of leaves that come ordered by group; one group is held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)].tolist()
            for first, past in zip(edges, edges[1:]):
                if held and group[first] != last:
                    yield subtree(pa.Table.from_batches(held), least)
                    held = []
                held.append(batch.slice(first, past - first))
                last = group[first]
        if held:
            yield subtree(pa.Table.from_batches(held), least)

    return work


def counted(docs: DataFrame, least: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, w1, n) of all counts; pairs (lang, w1, w2, n) and triples (.., w3, n) seen ``least`` times."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), filled(text_col).alias("text"))
    words = written(
        rows.mapInArrow(word_rows, "lang string, word string, key long, n long")
        .groupBy("lang", "word")
        .agg(F.first("key").alias("key"), F.sum("n").alias("n"))
    )
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = context.broadcast(bitmap_of(words.filter(F.col("n") >= least)))
    given_back(docs.sparkSession)  # the words' shuffle, now that jobs have read their table
    pairs = written(
        rows.mapInArrow(pair_rows(frequent), "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )
    heavy = [bitmap_of(x.filter(F.col("n") > HEAVY)) for x in (words, pairs)]
    bitmaps = context.broadcast((frequent.value, bitmap_of(pairs), *heavy))
    given_back(docs.sparkSession)  # the pairs' shuffle, before the larger one of the suffixes
    schema = "whole boolean, lang string, w1 string, w2 string, w3 string, n long"
    nodes = written(
        rows.mapInArrow(suffix_rows(bitmaps, 2 * total // BUDGET + 1), f"group long, {schema}")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(subtrees(least), schema)
    )
    two = nodes.filter("w3 IS NULL")
    parts = two.filter("NOT whole").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    two = two.filter("whole").select("lang", "w1", "w2", "n").union(parts)
    return words.select("lang", F.col("word").alias("w1"), "n"), two, nodes.filter("w3 IS NOT NULL").drop("whole")


def attached(rows: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
    """The rows with the count of the phrase ``words`` (columns) as ``name``; frequent words may hold very many rows."""
    key = F.struct("lang", *words)
    by_key = counts.select(F.struct("lang", *[F.col(f"w{k + 1}").alias(w) for k, w in enumerate(words)]).alias("_key"), F.col("n").alias(name))
    return hub_join(rows.withColumn("_key", key), by_key, "_key").drop("_key")


def scored(rows: DataFrame, l: str, r: str, name: str) -> DataFrame:  # noqa: E741
    """The rows with floor(1000000 * a * a / (l * r)), exact for counts below 10**15."""
    a, l, r = (f"cast({x} as decimal(15,0))" for x in ("a", l, r))  # noqa: E741
    return rows.withColumn(name, F.expr(f"(cast(1000000 as decimal(7,0)) * ({a} * {a})) div ({l} * {r})"))


def collocations(
    docs: DataFrame, least: int = 10, covered_percent: int = 50, best: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of two and three words of each language.

    A phrase is seen ``a`` times, at least ``least``; its weakest cut, into parts seen ``l`` and ``r`` times, gives its score
    floor(1000000 * a * a / (l * r)), of equal ones the first.  Phrases of which a longer one holds at least
    ``covered_percent`` of the occurrences are left out.
    """
    words, pairs, triples = counted(docs, least, text_col, lang_col)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.filter(F.col("n") >= least)

    two = pairs.withColumnRenamed("n", "a")
    two = attached(attached(two, words, ["w1"], "l"), words, ["w2"], "r")
    longer = triples.select("lang", "w1", "w2", "n").union(triples.select("lang", "w2", "w3", "n"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("n").alias("_longer"))
    two = (
        scored(two, "l", "r", "score")
        .join(longer, ["lang", "w1", "w2"], "left")
        .filter(F.coalesce(F.col("_longer"), F.lit(0)) * 100 < F.col("a") * covered_percent)
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    )
    three = triples.withColumnRenamed("n", "a")
    for parts, name in ((["w1"], "l1"), (["w2", "w3"], "r1"), (["w1", "w2"], "l2"), (["w3"], "r2")):
        three = attached(three, words if len(parts) == 1 else pairs, parts, name)
    three = scored(scored(three, "l1", "r1", "s1"), "l2", "r2", "s2")
    second = F.col("s2") < F.col("s1")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        *[F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))],
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.union(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
