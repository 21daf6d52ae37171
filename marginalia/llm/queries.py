"""The queries of this subpackage, over the tables of a folder, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, fim, fingerprints, hard_negatives, html_text, language_id, mixing, quality, sharding, simhash, topk_search, training_order, url_filters
from marginalia.llm.common import materialize, shared_path

#: The production tokenizer: a file of the installed package of public vocabularies.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.labelled_pages(pages, table(spark, sf_dir, "labels")))
    posterior = [F.round(c, url_filters.DIGITS).alias(c) for c in ("post_mean", "upper_good")]
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_good", *posterior)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_training_order(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    path, vocabulary = shared_path(spark, "shards"), bpe.vocabulary_size(tokenizer)
    # Ids of two bytes where they fit; the two ids after the vocabulary end a document and fill up the last sequence.
    width = 2 if vocabulary + 2 <= 1 << 16 else 4
    n = training_order.materialise(table(spark, sf_dir, "documents"), path, end=vocabulary, pad=vocabulary + 1, id_bytes=width, encode=partial(bpe.encode_texts, path=tokenizer))
    slots = training_order.read_slots(spark, path, id_bytes=width, ordered=False).select("shard", "slot", F.crc32("ids").alias("ids_crc32"))
    return training_order.sequence_at(slots, n)


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, digests=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_no")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Texts are read once, to count their tokens; all else is done on the narrow table.
    narrow = materialize(docs.select("doc_id", "lang", "source", mixing.tokens_of(F.col("text")).alias("tokens")), "counted")
    mixed = mixing.mix(narrow, tokens=F.col("tokens"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % hard_negatives.EVERY == 0)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % topk_search.EVERY == 0)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_fingerprints": op2_fingerprints,
    "op3_simhash": op3_simhash,
    "op4_training_order": op4_training_order,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_fim": op11_fim,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_topk_search": op13_topk_search,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.oracle(),
    "op9_mixing": mixing.oracle(),
    "op11_fim": fim.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
    "op13_topk_search": topk_search.oracle(),
}
