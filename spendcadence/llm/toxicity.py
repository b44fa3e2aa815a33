"""Toxicity scores of whole texts by a recurrent network trained here.

The network (see :mod:`spendcadence.llm.gru`) is fitted on a bounded sample of labelled rows: of each label at
most ``most`` documents with a text, the first by a hash of the id.  Of a text of more than ``longest`` bytes, stretches of
``STRETCH`` words drawn by a hash over its whole length are learnt from, of ``longest`` bytes together, so the sample has at
most sum(most) * longest bytes.  Of rows that repeat an id the least text is learnt from.
Rows whose crc32 of the id (as text) leaves 2 when divided by 4 are held out and never learnt from.  Scoring
covers every overlapping window of every text, in the tasks that read the rows; there is no shuffle.  Only the
text enters a score.

Null text counts as empty; an empty text is one window of padding and scores like any other.  Rows that repeat
get equal scores.  Labels that are null are not used, and a document labelled both ways counts as toxic.  With no
labelled rows the untrained network gives its scores.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcadence.llm.gru import Network, Scorer

MOST = (3000, 1000)  # training rows without and with the label
LONGEST = 30_000
THRESHOLD = 0.3
TOGETHER = 256  # texts scored at once
FOLDS, HELD_OUT = 4, 2
STRETCH = 64  # words


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, most: tuple[int, int], longest: int, id_col: str, text_col: str
) -> DataFrame:
    """_text and _label of the sample."""
    labelled = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.octet_length("_text") > 0)
    usable = labelled.join(texts.select("_id").distinct(), "_id", "left_semi")
    order = F.xxhash64("_id")
    chosen = [usable.filter(F.col("_label") == k).orderBy(order, "_id").limit(most[k]) for k in (0, 1)]
    # at most sum(most) rows of two numbers
    found = texts.join(F.broadcast(chosen[0].union(chosen[1])), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return found.select("_id", "_text", "_label").mapInArrow(shortened(longest), found.select("_id", "_text", "_label").schema)


def stretches(text: str, longest: int) -> str:
    """The text, or stretches of its words drawn by a hash, of about ``longest`` bytes."""
    size = len(text.encode())
    if size <= longest:
        return text
    words = text.split()
    parts = [" ".join(words[k : k + STRETCH]) for k in range(0, len(words), STRETCH)]
    kept, held = [], 0
    for k in sorted(range(len(parts)), key=lambda k: zlib.crc32(f"{k} {parts[k]}".encode())):
        part = parts[k].encode()[: longest - held].decode(errors="ignore")
        kept.append((k, part))
        held += len(part.encode()) + 1
        if held >= longest:
            break
    return " ".join(part for _, part in sorted(kept))


def shortened(longest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([stretches(t, longest) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], batch.schema.names)

    return work


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    most: tuple[int, int] = MOST,
    longest: int = LONGEST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Network:
    rows = training_rows(docs, labels, label_col, most, longest, id_col, text_col).collect()
    rows.sort(key=lambda r: (str(r["_id"]), r["_text"]))
    return Network().train([r["_text"] for r in rows], [r["_label"] for r in rows])


def scored(docs: DataFrame, network: Network, score_col: str, text_col: str = "text") -> DataFrame:
    """The rows as they are, with a score (0 to 1) added or replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    columns = [c for c in docs.columns if c != score_col]
    at = columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                texts = [text or "" for text in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts), pa.float64())], [*columns, score_col])

    rows = docs.select(*columns)
    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, held_out, score, predicted for each row."""
    network = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), network, "score", "_text")
    return rows.select(
        F.col("_id").alias(id_col),
        held_out("_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
