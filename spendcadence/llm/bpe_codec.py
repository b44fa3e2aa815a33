"""Byte-pair encoding and decoding of whole texts.

Encoding pops merge ranks from a priority queue over a doubly linked symbol list and skips stale entries;
decoding concatenates the vocabulary's strings with a space between tokens.  Null text counts as empty: no
tokens, and an empty decoded text.  Every row gives one row, so rows that repeat give equal rows; an empty
table gives an empty result.  Only the id and the text are read, whatever else a table holds.  There is no
shuffle: each task encodes the rows it reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.bpe import Remembered, Vocabulary, chunks, vocabulary

ID = np.dtype("<u4")


class Codec:
    """Ids as little-endian unsigned 32-bit integers in bytes, and back."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.by_piece = Remembered(self.encode_piece)
        self.by_chunk = Remembered(self.encode_chunk)
        self.decoded_chunk = Remembered(self.decode_ids)

    def encode_piece(self, piece: bytes) -> bytes:
        symbols = self.words.symbols(piece)
        self.words.merge(symbols)
        kept = [s for s in symbols if s >= 0]
        return pack(f"<{len(kept)}I", *kept)

    def encode_chunk(self, chunk: str) -> bytes:
        pieces = self.words.pieces(chunk)
        if len(pieces) == 1:
            return self.encode_piece(chunk.encode())
        return b"".join(map(self.by_chunk.__getitem__, pieces))

    def decode_ids(self, ids: bytes) -> str:
        return " ".join(map(self.words.strings.__getitem__, np.frombuffer(ids, ID).tolist()))

    def encode_chunks(self, text: str) -> list[bytes]:
        """Ids of the text, in parts that together are the whole."""
        found = chunks(text)
        if found is not None:
            return list(map(self.by_chunk.__getitem__, found))
        special = self.words.specials.values()
        return [
            np.array([part], ID).tobytes() if isinstance(part, int) and part in special else self.by_piece[part]
            for part in self.words.parts(text)
        ]

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_chunks(text))

    def decode_chunks(self, parts: list[bytes]) -> str:
        return " ".join(map(self.decoded_chunk.__getitem__, filter(None, parts)))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(vocabulary(path))


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(vocabulary_path)
        for batch in batches:
            ids = [np.frombuffer(tokens.encode(text.as_py()), ID).astype(np.int32) for text in batch.column(1)]
            sizes = pa.array([len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(ids, pa.list_(pa.int32()))], ["_id", "n_tokens", "ids"]
            )

    rows = with_text(docs, id_col, text_col)
    schema = T.StructType(
        [rows.schema["_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text for each row of ids; null ids give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(vocabulary_path).strings
        for batch in batches:
            texts = [" ".join(map(strings.__getitem__, ids.as_py() or [])) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    schema = T.StructType([rows.schema["_id"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and the SHA-256 of ids and of the decoded text: encode and decode in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(vocabulary_path)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column(1):
                parts = tokens.encode_chunks(text.as_py())
                ids = b"".join(parts)
                counts.append(len(ids) // ID.itemsize)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(tokens.decode_chunks(parts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = with_text(docs, id_col, text_col)
    schema = T.StructType(
        [
            rows.schema["_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)
