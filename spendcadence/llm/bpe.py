"""Byte-pair merging with a heap of ranks over a doubly linked list, and what precedes it.

A vocabulary file describes: special strings cut out of the raw text, a normaliser, a pattern that cuts text
into pieces, and ranked merges inside each piece, whose last symbol carries the end-of-word mark.

Pieces never span white space, so a text is cut at white space first and every such chunk is worked out once
and remembered.  Memory is bounded: beyond ``REMEMBERED`` chunks the older generation is forgotten, which
changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

REMEMBERED = 400_000
KEPT_CHUNK = 64  # characters; longer chunks hardly ever come again

# Characters for which lower-casing and cutting at white space agree between Python and the library: ASCII and
# precomposed Latin letters, without the four separators that only Python takes for white space and without the
# dotted capital I.  Texts with any other character, or with what may be a special string, take the library's own
# normaliser and pre-tokeniser.
UNCOMMON = re.compile("[^\x00-\x1b\x20-įı-ſ]|<\\|")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (chr(c) for c in range(0x100, 0x200))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class Vocabulary:
    """Symbols, ranked merges and the splitting rules of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary with word ends")
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.strings = {i: s for s, i in ids.items()} | {t["id"]: t["content"] for t in described["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        # by left symbol: right symbol -> rank; by rank: the merged symbol
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        for r, (a, b) in enumerate(pairs):
            self.rank[ids[a]][ids[b]] = r
        self.merged = [ids[a + b] for a, b in pairs]
        self.cut = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def symbols(self, piece: bytes) -> list[int]:
        inner = self.inner
        found = [inner[b] for b in piece]
        found[-1] = self.last[piece[-1]]
        return found

    def merge(self, symbols: list[int]) -> int:
        """Merge adjacent pairs in place, lowest rank first, leftmost of equals; returns the number of merges.

        A symbol that was merged into its left neighbour becomes -1.
        """
        rank, size = self.rank, len(symbols)
        heap = []
        left = symbols[0]
        for i in range(1, size):
            right = symbols[i]
            r = rank[left].get(right)
            if r is not None:
                heap.append(r << 32 | i - 1)
            left = right
        if not heap:
            return 0
        heapify(heap)
        symbols.append(-1)  # stands after the last, and pairs with nothing
        after, before = list(range(1, size + 1)), list(range(-1, size))
        merged, merges = self.merged, 0
        while heap:
            entry = heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or rank[left].get(symbols[j]) != r:
                continue  # stale: one of the two has changed since
            left = symbols[i] = merged[r]
            symbols[j] = -1
            merges += 1
            k = after[i] = after[j]
            before[k] = i
            r = rank[left].get(symbols[k])
            if r is not None:
                heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank[symbols[h]].get(left)
                if r is not None:
                    heappush(heap, r << 32 | h)
        symbols.pop()
        return merges

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of a lower-case chunk; a piece is cut no further when it comes again as a chunk."""
        return [chunk] if chunk.isalpha() else self.cut.findall(chunk)

    def parts(self, text: str) -> Iterator[int | bytes]:
        """Pieces of any text by the library's own rules; special strings come as their ids."""
        for part in self.special_pattern.split(text):
            if part in self.specials:
                yield self.specials[part]
            elif part:
                for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    yield bytes(map(self.byte_of.__getitem__, piece))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy for a process; the file is read where it is needed."""
    return Vocabulary(path)


class Remembered(dict):
    """Values of a function by key, in two generations."""

    def __init__(self, work: Callable):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= KEPT_CHUNK:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def chunks(text: str) -> list[str] | None:
    """Lower-case chunks between white space, or None where only the library's rules are sure to be right."""
    if UNCOMMON.search(text):
        return None
    return text.lower().split()
