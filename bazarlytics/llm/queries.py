"""The registered queries of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.llm import conversations, decontaminate, language, licenses, lines, packing, phrases, secrets, toxicity, wavelet
from bazarlytics.llm.common import crc32_mod, prepared
from bazarlytics.llm.embeddings import near_vectors
from bazarlytics.llm.sharding import even_shards
from bazarlytics.llm.simhash import simhash_groups
from bazarlytics.llm.tokens import default_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"))


def wavelet_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = wavelet.write_shards(_table(spark, folder, "documents"), default_path("word_bpe_49k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return wavelet.read_shards(files).select(
        "doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    third = crc32_mod(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels.where(third != 1))  # rows without an id are not held out
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(third == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )


def latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def viterbi_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    quarter = crc32_mod(F.col("doc_id"), 4)
    held_out = F.coalesce(quarter == 2, F.lit(False))  # rows without an id are not
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.match(_table(spark, folder, "documents"), licenses.default_templates(spark))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def metric_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(_table(spark, folder, "documents"), default_path("byte_bpe_50k.json"))
    rows = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(rows)


def balanced_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return even_shards(_table(spark, folder, "documents"))


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_digests(_table(spark, folder, "conversations"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeated_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_wavelet_token_files": wavelet_token_files,
    "op3_counterfactual_toxicity": counterfactual_toxicity,
    "op4_latent_decontamination": latent_decontamination,
    "op5_viterbi_language": viterbi_language,
    "op6_license_scan": license_scan,
    "op7_secret_scan": secret_scan,
    "op8_metric_near_dedup": metric_near_dedup,
    "op9_sum_of_squares_packing": sum_of_squares_packing,
    "op10_balanced_label_propagation": balanced_label_propagation,
    "op11_conversation_repair": conversation_repair,
    "op12_line_dedup": line_dedup,
    "op13_toivonen_collocations": phrase_collocations,
}

#: Only what no trained model, hash of Spark's or tokenizer takes part in can be stated.
SQL: dict[str, str] = {
    "op13_toivonen_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')), '[^ \\x09]+') AS w FROM documents),
        totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
        places AS (
            SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
            FROM pieces, range(1, 6) AS sizes(k) WHERE len(w) >= k),
        counts AS (
            SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a
            FROM places GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (
            SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS k FROM counts WHERE size > 1),
        scores AS (
            SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score, k
            FROM cuts c JOIN totals USING (lang)
            JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ')
            JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
        lowest AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (
            SELECT * FROM lowest c WHERE NOT EXISTS (
                SELECT 1 FROM counts b WHERE b.lang = c.lang AND 100 * b.a >= 100 * c.a
                AND len(b.phrase) > len(c.phrase) AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked WHERE rank <= 2000""",
    "op12_line_dedup": """
        WITH texts AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT row, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM texts),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < last) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id = last), ''))
                AS kept_sha256
        FROM keyed LEFT JOIN shared USING (key) GROUP BY row, doc_id""",
    "op8_metric_near_dedup": """
        WITH RECURSIVE sized AS (
            SELECT vec_id, embedding, len(embedding) = (
                SELECT len(embedding) FROM embeddings WHERE len(embedding) > 0
                GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS fits
            FROM embeddings),
        good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM sized
            WHERE vec_id IS NOT NULL AND fits
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM good
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        found AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id,
               coalesce(vec_id = coalesce(root, vec_id), false) AS kept
        FROM embeddings LEFT JOIN found ON vec_id = found.a LEFT JOIN counted ON vec_id = counted.a""",
}
