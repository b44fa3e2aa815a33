"""Term statistics and TF-IDF weights as rows: texts are split once for a vocabulary, also for every fold of a
cross-validation, and once for the weights.

A term is a word of two or more characters that is no stop word, or two such words that follow each other.  A null text
counts as empty; an empty text has no terms but counts as a document.

A pair is no more frequent than either of its words, neither in occurrences nor in texts.  So words are counted first; where
``size`` of them occur at least n times, no rarer word or pair is in the vocabulary, and only pairs of frequent words are
counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcadence.session import released, stored

VOCABULARY = 500
MIN_DOCS = 2
FREQUENT = 10_000  # words at most by which pairs are told; where more are equally frequent, all pairs are counted


def term_stages() -> list:
    """Words and word pairs of ``text`` in ``_terms``; nothing to fit."""
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"(?U)\w\w+", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]


def kept_words(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Rows (``keep``..., _kept): the words of a text that are no stop words, in order."""
    named = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return PipelineModel(stages=term_stages()[:2]).transform(named).select(*keep, "_kept")


def terms_among(words: Sequence[str] | None, firsts: Sequence[str] | None, seconds: Sequence[str] | None) -> Column:
    """Of the words in ``_kept`` those among ``words``, and the pairs of one of ``firsts`` and one of ``seconds``.

    None stands for all.
    """

    def among(word: Column, some: Sequence[str] | None) -> Column:
        return word.isNotNull() if some is None else word.isin(list(some))

    behind = F.slice("_kept", F.lit(2), F.greatest(F.size("_kept") - 1, F.lit(0)))
    pairs = F.zip_with(
        "_kept", behind, lambda a, b: F.when(among(a, firsts) & among(b, seconds), F.concat(a, F.lit(" "), b))
    )
    return F.concat(F.filter("_kept", lambda w: among(w, words)), F.filter(pairs, lambda p: p.isNotNull()))


def totals(terms: DataFrame, copies: str, by: Sequence[str]) -> DataFrame:
    """Rows (``by``..., term, _n, _docs): occurrences of the terms in ``_terms`` and texts that hold them.

    Every occurrence counts for ``_n`` and every different term of a text for ``_docs``, so no text's terms are gathered.
    """

    def each(column: Column, n: int, docs: int) -> Column:
        return F.transform(
            column, lambda t: F.struct(t.alias("term"), F.lit(n).cast("bigint").alias("n"), F.lit(docs).cast("bigint").alias("d"))
        )

    rows = terms.select(*by, copies, F.inline(F.concat(each(F.col("_terms"), 1, 0), each(F.array_distinct("_terms"), 0, 1))))
    return rows.groupBy(*by, "term").agg(
        F.sum(F.col("n") * F.col(copies)).alias("_n"), F.sum(F.col("d") * F.col(copies)).alias("_docs")
    )


def term_counts(terms: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (``keep``..., term, n): how often each term of ``_terms`` stands in a text.

    A text's terms are sorted within its row, so that equal terms are neighbours: counting needs no shuffle.
    """
    terms = terms.select(*keep, F.array_sort("_terms").alias("_sorted"))
    starts = F.filter(
        F.transform(
            "_sorted", lambda t, i: F.when((i == 0) | (F.get(F.col("_sorted"), i - 1) != t), i)
        ),
        lambda i: i.isNotNull(),
    )
    begun = terms.withColumn("_starts", starts)
    runs = F.transform(
        "_starts",
        lambda s, i: F.struct(
            F.get(F.col("_sorted"), s).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_sorted")) - s).cast("bigint").alias("n"),
        ),
    )
    return begun.select(*keep, F.inline(runs))


def vocabulary(df: DataFrame, text: str = "text", size: int = VOCABULARY, min_docs: int = MIN_DOCS,
               copies: str | None = None) -> DataFrame:
    """Rows (index, term, docs, idf) of the ``size`` most frequent terms of at least ``min_docs`` texts.

    Equally frequent terms come in byte order; ``idf`` is ln((texts + 1) / (docs + 1)) + 1.  A row stands for as many
    texts as its column ``copies`` says, else for one.
    """
    return fold_vocabularies(df.withColumn("_fold", F.lit(0)), "_fold", 0, text, size, min_docs, copies).drop("fold")


def fold_vocabularies(df: DataFrame, fold: str, folds: int, text: str = "text", size: int = VOCABULARY,
                      min_docs: int = MIN_DOCS, copies: str | None = None) -> DataFrame:
    """Rows (fold, index, term, docs, idf): for each fold the vocabulary of all other folds.

    Terms are counted once for each (fold, term); a held-out fold is subtracted from the total.  With 0 folds nothing
    is held out and there is one vocabulary, of fold 0.  At most ``size`` rows a fold come out, and every task hands on
    no more than those, so that the few folds are no bottleneck.  The texts' words and the result are written below the
    checkpoint folder; the words go again.
    """
    df = df.withColumns({"_at": F.col(fold), "_copies": F.lit(1).cast("bigint") if copies is None else F.col(copies)})
    texts = df.groupBy("_at").agg(F.sum("_copies").alias("_texts"))
    kept = stored(kept_words(df, ["_at", "_copies"], text))
    words = stored(totals(kept.withColumn("_terms", F.col("_kept")), "_copies", ["_at"]))
    frequent = frequent_words(words, folds, size, min_docs)
    counted = totals(kept.withColumn("_terms", terms_among(frequent, frequent, frequent)), "_copies", ["_at"])
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("_n"), "term"))
    chosen = left_over(counted, folds, min_docs).withColumn("index", place).filter(F.col("index") <= size)
    in_all = texts.agg(
        F.sum("_texts").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_at", "_texts"))).alias("_by_fold")
    )
    # One row: the numbers of texts.
    away = F.coalesce(F.element_at("_by_fold", F.col("fold")), F.lit(0)) if folds else F.lit(0)
    of = F.col("_all") - away
    found = stored(chosen.withColumn("_one", F.lit(1)).join(F.broadcast(in_all.withColumn("_one", F.lit(1))), "_one").select(
        "fold", (F.col("index") - 1).alias("index"), "term", "docs",
        (F.ln((of + 1) / (F.col("docs") + 1)) + 1).alias("idf"),
    ))
    released(kept)
    released(words)
    return found


def left_over(counted: DataFrame, folds: int, min_docs: int) -> DataFrame:
    """Rows (fold, term, _n, docs) of the terms that at least ``min_docs`` texts outside the fold hold."""
    held = F.explode(F.array(*[F.lit(f) for f in range(folds)])) if folds else F.lit(0)
    # One entry for each fold: bounded by the number of folds.
    of_term = counted.groupBy("term").agg(
        F.sum("_n").alias("_all_n"), F.sum("_docs").alias("_all_docs"),
        F.map_from_entries(F.collect_list(F.struct("_at", F.struct("_n", "_docs")))).alias("_own"),
    ).withColumn("fold", held)

    def without(total: str, part: str):
        own = F.element_at("_own", F.col("fold"))[part] if folds else F.lit(None)
        return F.col(total) - F.coalesce(own, F.lit(0))

    return of_term.select(
        "fold", "term", without("_all_n", "_n").alias("_n"), without("_all_docs", "_docs").alias("docs")
    ).filter(F.col("docs") >= min_docs)


def frequent_words(words: DataFrame, folds: int, size: int, min_docs: int) -> list[str] | None:
    """All words that can be in a vocabulary, alone or in a pair; None if they are more than ``FREQUENT``."""
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("_n"), "term"))
    last = left_over(words, folds, min_docs).withColumn("_place", place).filter(F.col("_place") == size).select("_n").collect()
    least = min((r["_n"] for r in last), default=0) if len(last) == max(folds, 1) else 0
    some = words.groupBy("term").agg(F.sum("_n").alias("_n"), F.sum("_docs").alias("_docs"))
    some = some.filter((F.col("_n") >= least) & (F.col("_docs") >= min_docs)).select("term").limit(FREQUENT + 1).collect()
    return [r["term"] for r in some] if len(some) <= FREQUENT else None


def tfidf_rows(df: DataFrame, terms: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Rows (id, index, term, weight): the non-zero weights of each text, (1 + ln n) * idf brought to unit length.

    ``terms`` is a vocabulary: at most a few hundred rows, sent everywhere.  Only terms of the vocabulary are counted and
    shuffled, at most as many for a text as it has rows.  Ids must be distinct.
    """
    wanted = [r["term"].split(" ") for r in terms.select("term").collect()]
    words, pairs = [t[0] for t in wanted if len(t) == 1], [t for t in wanted if len(t) == 2]
    found = kept_words(df, [id_col], text).withColumn(
        "_terms", terms_among(words, sorted({a for a, _ in pairs}), sorted({b for _, b in pairs}))
    )
    known = term_counts(found, [id_col]).join(F.broadcast(terms.select("term", "index", "idf")), "term")
    raw = known.withColumn("_raw", (F.ln("n") + 1) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "index", "term", (F.col("_raw") / length).alias("weight"))
