"""The registered queries of the operators, with production parameters on whole tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.llm import alignment, decontaminate, jaccard, lm, mixing, negatives, personal, search, secrets, sharding, suffixes, toxicity, urls
from plumbrow.session import scratch_path
from plumbrow.sources.views import table


def id_remainder(name: str, divisor: int) -> Column:
    """CRC-32 of an id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(divisor))


def op1_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = id_remainder("doc_id", 7) == 2
    return lm.fit(docs, train=~held_out).score(docs, held_out=held_out)


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


MIX_WEIGHTS = (3.0, 1.0, 2.0)


def op3_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf, "documents"), lambda n: MIX_WEIGHTS[n % len(MIX_WEIGHTS)])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """One row a benchmark passage found in a document; clean documents have none."""
    return decontaminate.passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OLD_SHARDS, NEW_SHARDS = 12, 8


def text_shard(text: Column, shards: int) -> Column:
    """The shard of a text in a layout by CRC-32."""
    return F.pmod(F.crc32(F.coalesce(text, F.lit(""))), F.lit(shards))


def op5_reshard(spark: SparkSession, sf: str) -> DataFrame:
    """From 12 shards by CRC-32 of the text to 8 of equal bytes; the rows are those of the written files."""
    docs = table(spark, sf, "documents")
    placed = sharding.reshard_files(docs, text_shard(F.col("text"), OLD_SHARDS), NEW_SHARDS, scratch_path(spark, "shards"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf, "documents")).drop("text_hash")


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind, *_ in secrets.KINDS],
        F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"),
    )


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", search.quantised(F.col("embedding")).alias("vector"))
    return search.search(vectors, F.col("vec_id") % 50 == 0)


URL_RULES = """
    SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)
"""


def op9_url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"), spark.sql(URL_RULES), keep=["page_id"])


TOXIC_AT = 0.3


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf, "labels"), train=~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every seventh id are moved on by one, so that near rows of another label exist."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", moved.alias("label"), search.quantised(F.col("embedding")).alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = personal.find_personal(docs, personal.fit(docs), keep=["doc_id"])
    return found.select(
        "doc_id", *[personal.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(personal.spelled(F.col("base")), 256).alias("base_sha256"), personal.spelled(F.col("spans")).alias("spans"),
    )


#: The vocabulary files of op13; their folder is a parameter of the cluster.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op13_token_links(spark: SparkSession, sf: str) -> DataFrame:
    files = alignment.Files.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    linked = alignment.link_tokens(table(spark, sf, "documents"), files, keep=["doc_id"])
    return linked.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_suffix_dedup, op3_mix, op4_decontaminate, op5_reshard, op6_jaccard, op7_secrets, op8_topk, op9_url_verdicts, op10_toxicity, op11_hard_negatives, op12_personal_data, op13_token_links)}
ORACLE: dict[str, str] = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
                list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
            AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op9_url_verdicts": """
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM rest
        ), rules(h, p, v) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), best AS (
            SELECT page_id, host, path, h || p AS rule, v FROM parts LEFT JOIN rules
                ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
    """,
}
