"""A corpus pipeline over documents: toxic ones go, copies go, near copies go, repeated passages go, the rest is packed.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.  ``run`` writes the stages' results into a folder of its own under
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendcadence.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from spendcadence.llm.registry import importable, table
from spendcadence.llm.shared import fresh, shared_folder
from spendcadence.session import tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold; null and empty texts are scored like any other."""
    network = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_toxicity")
    scored = toxicity.scored(docs, network, name)
    return scored.filter(scored[name] < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after folding white space) the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the smallest doc_id."""
    return ngram_join.drop_near_copies(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that stand earlier already; ``n_chars`` follows the text."""
    left = substring_dedup.remove_repeats(docs, percent=80, removed_col=fresh(docs, "_removed"))
    return substring_dedup.recounted(left).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# A trained network has no SQL twin; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    importable(tune(spark))
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
