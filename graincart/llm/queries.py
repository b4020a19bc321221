"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.llm import decontaminate, embeddings, langid, lmscore, packing, quality, sharding, simhash, toxicity, urls
from graincart.llm.common import TOKENIZER, configure, id_remainder, read_table


# The rules of the URL filter query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = id_remainder("doc_id", 4) == 2
    model = langid.train(docs, held)
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, TOKENIZER))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.score_documents(docs).withColumn("score", F.round("score", 4))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_id", "coverage")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_remainder("doc_id", 5) == 0
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), held)
    scored = quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.drop("text").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_remainder("doc_id", 3) == 1
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), held)
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.drop("text").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).drop("root")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_sharding, op4_lm_scoring, op5_url_filters, op6_quality_classifier, op7_simhash_near_dedup, op8_embedding_near_dedup, op9_toxicity, op10_benchmark_decontamination)}

_URL_SQL = """
WITH split AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(r_verdict, r_host, r_path) AS (VALUES RULES)
SELECT page_id, host, path,
       (SELECT max_by(r_host || r_path, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
       coalesce((SELECT max_by(r_verdict, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
FROM split
""".replace("RULES", ", ".join(map(str, URL_RULES)))

_LM_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     tokens AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM split),
     grams AS (SELECT doc_id, i, CASE WHEN i > 2 THEN ws[i - 2] ELSE '' END AS a, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS b, ws[i] AS c FROM tokens),
     uni AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
     bi AS (SELECT b, c, count(*) AS n FROM grams GROUP BY b, c),
     tri AS (SELECT a, b, c, count(*) AS n FROM grams GROUP BY a, b, c),
     total AS (SELECT count(*) AS words, count(*) FILTER (WHERE i = 1) AS texts FROM grams),
     scored AS (SELECT tri.a, tri.b, tri.c,
                       CASE WHEN tri.n > 1 THEN log10((tri.n - 1) / ((CASE WHEN tri.b = '' THEN texts ELSE bi2.n END) - 1))
                            WHEN bi.n > 1 THEN log10(0.4) + log10((bi.n - 1) / ((CASE WHEN tri.b = '' THEN texts ELSE uni1.n END) - 1))
                            WHEN uni.n > 1 THEN 2 * log10(0.4) + log10((uni.n - 1) / (words - 1))
                            ELSE 3 * log10(0.4) + log10(1 / words) END AS s
                FROM tri JOIN uni ON uni.c = tri.c JOIN bi ON bi.b = tri.b AND bi.c = tri.c
                LEFT JOIN uni AS uni1 ON uni1.c = tri.b LEFT JOIN bi AS bi2 ON bi2.b = tri.a AND bi2.c = tri.b, total),
     sums AS (SELECT doc_id, sum(s) AS s FROM grams JOIN scored USING (a, b, c) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(s / len(ws), 4) AS score FROM split LEFT JOIN sums USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_lm_scoring": _LM_SQL, "op5_url_filters": _URL_SQL}
