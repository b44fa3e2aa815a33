"""The registered queries: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spendcadence.llm import bpe_codec, collocations, exact_dedup, fingerprints, ngram_join, packing, runs, sharding, substring_dedup, suffix_dedup, token_counts, topk, toxicity
from spendcadence.llm.registry import query, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


@query(
    "op1_exact_dedup",
    r"""
    WITH normal AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
    )
    SELECT doc_id,
           min(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept,
           sha256(norm) AS text_sha256
    FROM normal
    WINDOW same AS (PARTITION BY norm)
    """,
)
def op1_exact_dedup(spark, sf_dir):
    docs = exact_dedup.annotate(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORDS, limit=2048)


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.components_of(table(spark, sf_dir, "documents"), percent=80)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_bpe_codec")
def op6_bpe_codec(spark, sf_dir):
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), WORDS)


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, end_id=1, capacity=4096)


@query(
    "op9_exact_topk",
    """
    WITH whole AS (
        SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        GROUP BY vec_id
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    ),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5
    """,
)
def op9_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=100)


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = runs.with_periods(table(spark, sf_dir, "documents"))
    return runs.summary(runs.collapse_runs(docs))


@query("op12_document_fingerprints")
def op12_document_fingerprints(spark, sf_dir):
    found = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "shared_start",
        "shared_end",
    )


@query(
    "op13_phrase_collocations",
    r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, words
        FROM (
            SELECT lang, unnest(list_transform(
                regexp_split_to_array(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
                ),
                lambda p: list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '')
            )) AS words
            FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
        )
    ),
    placed AS (SELECT piece, lang, unnest(words) AS w1, unnest(range(len(words))) AS i FROM pieces),
    near AS (
        SELECT lang, w1, lead(w1) OVER here AS w2, lead(w1, 2) OVER here AS w3
        FROM placed WINDOW here AS (PARTITION BY piece ORDER BY i)
    ),
    f1 AS (SELECT lang, w1, count(*) AS a FROM near GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS a FROM near WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM near WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    longer AS (
        SELECT lang, w1, w2, max(a) AS most
        FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL
    ),
    cuts AS (
        SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.a, l.a AS l, r.a AS r
        FROM f2 c
        JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1
        JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
        LEFT JOIN longer m ON m.lang = c.lang AND m.w1 = c.w1 AND m.w2 = c.w2
        WHERE m.most IS NULL OR 100 * m.most < 50 * c.a
        UNION ALL
        SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.a, l.a, r.a
        FROM f3 c
        JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1
        JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
        UNION ALL
        SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.a, l.a, r.a
        FROM f3 c
        JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2
        JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3
    ),
    scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
    stays AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays
    )
    SELECT ranked.lang, rank, phrase, a, l, r, n, score
    FROM ranked JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang) t ON t.lang = ranked.lang
    WHERE rank <= 2000
    """,
)
def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
