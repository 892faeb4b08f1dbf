"""The queries of the corpus operators, over the tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import chat, common, decontaminate, langid, maxent_lm, neardup_vectors, packing, quality, simhash, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.vector_groups(_table(spark, sf_dir, "embeddings"))


def op4_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op6_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_hmm_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op9_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out, with_payload=False).drop("url")


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_pu_quality,
        op3_metric_range_join,
        op4_simhash_multi_index,
        op5_rank_order_langid,
        op6_prefix_doubling_dedup,
        op7_benchmark_decontamination,
        op8_hmm_chat,
        op9_warc_writer,
        op10_maxent_lm,
    )
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"

ORACLE_SQL = {
    "op3_metric_range_join": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
        c AS (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY 1),
        n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op6_prefix_doubling_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        e AS (SELECT doc_id, least(128, len(x) // 2 - 49 - i) AS n, i, substr(x, 2 * i + 1, 354) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 128)) AS i FROM d)),
        w AS (SELECT doc_id, i + j AS i, substr(y, 2 * j + 1, 100) AS s FROM (SELECT doc_id, i, y, unnest(range(0, n)) AS j FROM e)),
        m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
        r AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE doc_id > least),
        g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS fresh FROM r),
        k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
        a AS (SELECT doc_id, k, min(i) AS low, max(i) + 50 AS high FROM k GROUP BY 1, 2),
        b AS (SELECT doc_id, k, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM a),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS last,
                     string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY k) AS head FROM b JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op7_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        p AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM p),
        q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
        h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM q) JOIN bw USING (n, s)),
        x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
        y AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "op9_warc_writer": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
}
