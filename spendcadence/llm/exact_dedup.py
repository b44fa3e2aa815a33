"""Exact deduplication by 128-bit content hash, with the bytes compared inside each hash group.

Texts are equal when they are identical after each run of ASCII white space has become one space.  Null
counts as empty, so null and empty texts form one group with other texts that normalise to nothing; a text
of white space alone normalises to one space and is a group of its own.  Of equal texts the smallest id
stays; a null id is never the smallest, and where all ids are null no row is preferred (``keep_id`` is null
and all of them stay).  Rows that repeat an id together with its text are one document: each counts in
``group_size`` and each carries the same decision.  An empty table gives an empty result.

Plan: texts meet once, pre-aggregated before the shuffle (``groupBy(hash, text)`` compares the bytes of
equal hashes, and a hot text leaves each map task as one row).  What follows is narrow: rows carry only
their two digests back to the groups, in a join whose both sides are shuffled for it, so that adaptive
execution can split the partition of a hot text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcadence.llm.shared import filled

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(filled(text), WHITE, " ")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: _hash (128 bits), _sha, keep_id, group_size."""
    texts = (
        docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
        .groupBy(F.unhex(F.md5("_norm")).alias("_hash"), "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # Different texts of one hash stay apart: each keeps its own entry, told by the second digest.
    entry = F.struct(F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")
    by_hash = texts.groupBy("_hash").agg(F.collect_list(entry).alias("_texts"))
    digests = F.transform("_texts", lambda t: t["_sha"])
    told_apart = F.when(
        F.size(F.array_distinct(digests)) < F.size(digests),
        F.raise_error(F.lit("two different texts agree in both digests")),
    ).otherwise(F.col("_texts"))
    return by_hash.select("_hash", F.inline(told_apart))


def decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as _row, with keep_id, group_size, kept and _sha."""
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.unhex(F.md5(normalised(text_col))).alias("_hash"),
        F.sha2(normalised(text_col), 256).alias("_sha"),
    )
    return rows.join(text_groups(docs, id_col, text_col), ["_hash", "_sha"]).withColumn(
        "kept", F.col("_id").eqNullSafe(F.col("keep_id"))
    )


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; other columns of these names give way."""
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    own = [F.col(f"_row.{c}") for c in docs.columns if c not in added or c in (id_col, text_col)]
    return decided(docs, id_col, text_col).withColumnRenamed("_sha", "text_sha256").select(*own, *added)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return decided(docs, id_col, text_col).filter("kept").select("_row.*")
