"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm import bpe, decontaminate, filter_audit, html_extract, licenses, near_duplicates, ngram_bloom, packing, prefix_trie, quality, suffix_dedup, toxicity, va_search
from tercet.llm.common import table

#: Scores from here up predict label 1.
CUT = 0.7


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def tokenizer_path() -> str:
    """The rank file of the query; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    got = toxicity.score(docs, model)
    return got.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_hits")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), width=200)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"), n=2, percent=80)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    got = quality.score(docs, model)
    return got.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids; 50256, which the vocabulary leaves free, ends documents and fills up rows."""
    import public_tokenizers

    tokens = bpe.encode_by_library(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.PATTERN)
    return packing.pack(tokens, length=2048, pad=50256, end=50256, dtype="<u2")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of words, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = ngram_bloom.train(docs.where(~held_out(10, 0)), order=2)
    got = ngram_bloom.score(docs, model)
    return got.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_packing": op7_token_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extract": op9_html_extract,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_lm_score": op12_lm_score,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op2_license_scan": licenses.SQL,
    "op4_exact_topk": va_search.SQL,
    "op5_minhash_near_duplicates": near_duplicates.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
