"""Periodic runs of words by suffix trees, and texts without the repetitions.

A run is a stretch of words with smallest period ``q`` and at least ``max(LEAST_WORDS, LEAST_POWER * q)`` words that
no neighbouring word extends.  Runs are found by longest common extensions:

1. Ukkonen's algorithm builds the suffix trees of a word sequence and of its reversal.  The Euler tour of a tree is
   kept where it turns from one leaf to the next; the shallowest turn between two leaves is their lowest common
   ancestor, which a sparse table gives in constant time.  Its depth is the longest common extension of two places.
2. A run of period ``q`` has a Lyndon root: at some place the longest Lyndon word, in the order of the symbols or in
   the opposite one, has ``q`` words and lies in the run.  The longest Lyndon word from a place ends where the next
   smaller suffix begins, so each place gives two candidates.
3. A candidate is extended to both sides by one extension in either tree, and is a run if it is long enough.

Trees are built only over stretches that can hold a run: in one, each three words in a row occur at least three times,
so places whose three words are rarer within their stretch cut the text, until nothing changes.  That rules out places
and never a run.  It goes by 64-bit hashes of words without regard to case, of which equal words have equal ones.

There is no shuffle.  Memory grows with the longest such stretch of one text (about 1 kB a word).

Words are ``[^\\x20\\x09-\\x0D]+``, told apart by all their bytes.  Null and empty texts have no words, no runs and an
empty collapsed text.  Every row gives one row, so repeated rows give equal ones, null ids stay null, and an empty table
gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.shared import filled
from spendcadence.llm.shingles import PLACE, blocks, buffers, mixed, word_hashes

LEAST_WORDS, LEAST_POWER = 6, 4
GRAM, OFTEN = 3, 3  # every GRAM words of a run occur at least OFTEN times in it

Run = tuple[int, int, int]  # start, length, period


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 0, closed by an end symbol of its own."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, -1]
        size = len(text)
        self.children: list[dict[int, int]] = [{}]
        self.first, self.past = [0], [0]  # the edge to a node; an open edge ends with the text
        links = [0]
        children, first, past = self.children, self.first, self.past
        node, edge, matched, waiting = 0, 0, 0, 0
        for at, symbol in enumerate(text):
            waiting += 1
            inner = 0  # the inner node made last, which waits for its suffix link
            while waiting:
                if not matched:
                    edge = at
                below = children[node].get(text[edge])
                if below is None:
                    children[node][text[edge]] = len(children)
                    children.append({})
                    first.append(at)
                    past.append(size)
                    links.append(0)
                    if inner:
                        links[inner] = node
                        inner = 0
                else:
                    span = min(past[below], at + 1) - first[below]
                    if matched >= span:
                        node, edge, matched = below, edge + span, matched - span
                        continue
                    if text[first[below] + matched] == symbol:
                        if inner and node:
                            links[inner] = node
                        matched += 1
                        break
                    split = len(children)
                    children[node][text[edge]] = split
                    children.append({symbol: split + 1, text[first[below] + matched]: below})
                    first.append(first[below])
                    past.append(first[below] + matched)
                    links.append(0)
                    children.append({})
                    first.append(at)
                    past.append(size)
                    links.append(0)
                    first[below] += matched
                    if inner:
                        links[inner] = split
                    inner = split
                waiting -= 1
                if not node and matched:
                    matched -= 1
                    edge = at - waiting + 1
                elif node:
                    node = links[node]

    def leaves(self, end_last: bool = False) -> tuple[list[int], list[int]]:
        """Suffixes in the order of their symbols, and how deep the tour turns between each and the one before."""
        children, first, past, size = self.children, self.first, self.past, len(self.text)
        order, turns = [], []
        turn = 0
        stack = [(0, 0, 0)]  # node, its depth, depth of the turn before it (or -1 if it is its parent's first)
        while stack:
            node, depth, before = stack.pop()
            if before >= 0:
                turn = before
            below = children[node]
            if not below:
                order.append(size - depth)
                turns.append(turn)
                continue
            ranked = sorted(below)
            if end_last and ranked[0] < 0:
                ranked.append(ranked.pop(0))
            for symbol in reversed(ranked[1:]):
                child = below[symbol]
                stack.append((child, depth + past[child] - first[child], depth))
            child = below[ranked[0]]
            stack.append((child, depth + past[child] - first[child], -1))
        return order, turns


class Extensions:
    """Longest common extensions of places, in constant time each, from a tree's leaves and turns."""

    def __init__(self, order: list[int], turns: list[int]):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.least = [np.array(turns, np.int32)]
        step = 1
        while 2 * step <= len(turns):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i <> j; the place behind the last symbol is allowed."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        return out


def lyndon_ends(rank: list[int]) -> list[int]:
    """Where the longest Lyndon word from each place ends: at the next place whose suffix ranks lower."""
    ends = [0] * len(rank)
    waiting: list[int] = []
    for at, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            ends[waiting.pop()] = at
        waiting.append(at)
    return ends  # the end symbol ranks lowest, so only its own place stays open


def runs_of(symbols: list[int]) -> list[Run]:
    """All runs of a sequence of numbers from 0, by start and period."""
    n = len(symbols)
    if n < LEAST_WORDS:
        return []
    tree = SuffixTree(symbols)
    order, turns = tree.leaves()
    forth = Extensions(order, turns)
    opposite = np.empty(n + 1, np.int64)
    opposite[tree.leaves(end_last=True)[0][::-1]] = np.arange(n + 1)
    back = Extensions(*SuffixTree(symbols[::-1]).leaves())
    places = np.arange(n)
    starts, periods = [], []
    for rank in (forth.rank, opposite):
        period = np.array(lyndon_ends(rank.tolist())[:n], np.int64) - places
        at = np.flatnonzero(LEAST_POWER * period <= n)
        starts.append(at)
        periods.append(period[at])
    i, q = np.concatenate(starts), np.concatenate(periods)
    if not len(i):
        return []
    right = forth(i, i + q)
    left = back(n - i, n - i - q)
    length = left + q + right
    good = length >= np.maximum(LEAST_WORDS, LEAST_POWER * q)
    found = np.unique(np.stack([i - left, q, length], axis=1)[good], axis=0)
    return [(start, length, period) for start, period, length in found.tolist()]


def recurring(grams: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (first, past) of neighbouring grams of one group of which each occurs OFTEN times within its stretch."""
    at = np.arange(len(grams))
    least = LEAST_WORDS - GRAM + 1
    while len(at):
        _, which, counts = np.unique(mixed(grams[at] + mixed(group[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        kept = at[counts[which] >= OFTEN]
        if not len(kept):
            break
        new = np.r_[True, (kept[1:] != kept[:-1] + 1) | (group[kept][1:] != group[kept][:-1])]
        part = np.cumsum(new) - 1
        long_enough = np.bincount(part)[part] >= least
        done = len(kept) == len(at) and long_enough.all()
        first, past = kept[new], kept[np.r_[new[1:], True]] + 1
        if done:
            return first, past
        at = kept[long_enough]
        group = group.copy()
        group[kept] = part
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def batch_runs(texts: pa.Array) -> list[list[Run]]:
    """The runs of each text."""
    found: list[list[Run]] = [[] for _ in range(len(texts))]
    data, offsets = buffers(texts)
    for low, high in blocks(offsets):
        part = data[offsets[low] : offsets[high]]
        words, starts, stops, row = word_hashes(part, offsets[low : high + 1] - offsets[low])
        places = len(words) - GRAM + 1
        if places <= 0:
            continue
        grams = words[:places] * PLACE[0]
        for k in range(1, GRAM):
            grams += words[k : k + places] * PLACE[k]
        whole = np.flatnonzero(row[:places] == row[GRAM - 1 :])
        # Places are numbered with a gap between rows, as a row's last places start no gram.
        group = row[:places].astype(np.int64)
        group[row[:places] != row[GRAM - 1 :]] = -1
        firsts, pasts = recurring(grams, np.where(group < 0, len(texts) + np.arange(places), group))
        if not len(whole):
            continue
        row_start = np.searchsorted(row, np.arange(high - low))
        for first, past in zip(firsts.tolist(), (pasts + GRAM - 1).tolist()):
            numbers: dict[bytes, int] = {}
            symbols = [
                numbers.setdefault(part[a:b].tobytes(), len(numbers))
                for a, b in zip(starts[first:past].tolist(), stops[first:past].tolist())
            ]
            owner = int(row[first])
            shift = first - int(row_start[owner])
            found[low + owner].extend((start + shift, length, q) for start, length, q in runs_of(symbols))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


PARTS = ["start", "length", "period"]
RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in PARTS]))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of start, length, period by start and period), collapsed (text) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch_runs(batch.column(1))
            left = [
                b" ".join(collapsed(text.as_buffer().to_pybytes().split(), runs)) if len(text.as_buffer()) else b""
                for text, runs in zip(batch.column(1), found)
            ]
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            sizes = np.cumsum([0] + [len(runs) for runs in found])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], PARTS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), structs),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                ["_id", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), filled(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where about a tenth of the texts repeat a stretch of words to their end.

    With h the CRC-32 of the id in decimals and g = h div 10: if h leaves 0 when divided by 10, each of the n words i
    from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), filled(text_col).alias("_text"), F.crc32(F.col(id_col).cast("string")).alias("_h")
    )
    g = F.floor(F.col("_h") / 10)
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_words"))
    a = F.when(F.col("_n") > 0, F.pmod(g, F.col("_n"))).cast("int")
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    parts = chosen.withColumn("_a", a).withColumn("_p", period)
    # The words before a, the first period, and that period again, whole and cut off, up to n words.
    rest = F.col("_n") - F.col("_a")
    root = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    edited = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a")), again)
    return parts.select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, edited).otherwise(F.col("_text")).alias(text_col))


def strongest(runs: str) -> Column:
    """The run of greatest length / period, the first of equal ones; null without runs."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(
        runs,
        F.lit(None).cast(kind),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in PARTS)), F.lit("\n")))
    best = found.withColumn("_best", strongest("runs"))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
