"""The queries opN_<name> and the pipeline, with production parameters, and their DuckDB SQL where there is any."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import ann, bpe, decontaminate, html_extract, lm, pii, quality, simhash, toxicity, url_filter
from quaestor.llm.common import crc_mod, table

#: The tokenizer's file: QUAESTOR_TOKENIZER, else where the vocabularies' own module says it is.
TOKENIZER = os.environ.get("QUAESTOR_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    found = toxicity.score(docs, labels)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "matched",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER).withColumnRenamed("id", "doc_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    blocked = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    found = url_filter.judged(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("id"), blocked.alias("blocked")), URL_RULES)
    return found.withColumnRenamed("id", "page_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = pii.pseudonymised(docs.withColumn("before", F.col("text")))
    return changed.select("doc_id", "text", F.coalesce(F.col("text") != F.col("before"), F.lit(False)).alias("changed"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.scored(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)
    held = F.coalesce(crc_mod(F.col("id"), 5) == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_simhash_near_dedup, op3_ann, op4_toxicity, op5_bpe, op6_url_filter, op7_quality, op8_decontaminate, op9_pii, op10_lm,
    )
}



def _shingled(table_: str, key: str) -> str:
    """Distinct (key, s) five-word shingles; fewer words are one shingle."""
    words = f"select {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from {table_} where text is not null"
    grams = "case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end"
    return f"select distinct {key}, unnest({grams}) as s from ({words}) where len(w) > 0"


ORACLES: dict[str, str] = {
    "op8_decontaminate": f"""with d as ({_shingled('documents', 'doc_id')}), i as ({_shingled('benchmark', 'item_id')}),
n as (select item_id, count(*) as item_shingles from i group by item_id),
f as (select doc_id, item_id, count(*) as found from i join d using (s) group by doc_id, item_id)
select doc_id, item_id, item_shingles, found, found / item_shingles::double as containment from f join n using (item_id) where found >= 0.8 * item_shingles""",
}
