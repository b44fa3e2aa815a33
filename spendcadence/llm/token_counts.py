"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

The count of a piece is its number of initial symbols minus its number of merges.  Null text counts as empty
and has no tokens; texts of any length are counted whole.  Every row gives one row, so rows that repeat give
equal rows; an empty table gives an empty result.  Only the id and the text are read, whatever else a table
holds.  There is no shuffle: each task counts the rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.bpe import Remembered, Vocabulary, chunks, vocabulary


def count_piece(words: Vocabulary, piece: bytes) -> int:
    return len(piece) - words.merge(words.symbols(piece))


class Counter:
    """Counts tokens of whole texts by one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.by_piece = Remembered(lambda piece: count_piece(words, piece))
        self.by_chunk = Remembered(self.count_chunk)

    def count_chunk(self, chunk: str) -> int:
        pieces = self.words.pieces(chunk)
        if len(pieces) == 1:
            return count_piece(self.words, chunk.encode())
        return sum(map(self.by_chunk.__getitem__, pieces))

    def __call__(self, text: str) -> int:
        found = chunks(text)
        if found is not None:
            return sum(map(self.by_chunk.__getitem__, found))
        return sum(1 if isinstance(part, int) else self.by_piece[part] for part in self.words.parts(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary_path)
        for batch in batches:
            totals = [tokens(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = T.StructType(
        [rows.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return rows.mapInArrow(count, schema).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
