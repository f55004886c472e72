"""The registered queries of the training-data operators, and their SQL.

Every query reads its whole table from ``sf_dir`` and applies one operator
with its production parameters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, middle, neighbours, packing, personal, quality, secrets, sentencepiece_codec, simhash, substrings, token_files, urls, vector_codes
from .common import table

#: Where the vocabularies are; a parameter of the operators.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and lengths by merges and by Viterbi, and digests of both decodings."""
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    count = lambda ids: (F.octet_length(ids) / 4).cast("long")
    return sentencepiece_codec.round_trip_documents(docs, model).select(
        "doc_id",
        count("ids").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
        count("viterbi_ids").alias("viterbi_tokens"),
        F.crc32("viterbi_ids").alias("viterbi_crc32"),
        F.sha2("viterbi_text", 256).alias("viterbi_decoded_sha256"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.read_token_files(token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), end_id=2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text")).drop("lost", "clean_text")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return substrings.dedup_substrings(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with errors, and a digest of all final codebook entries."""
    made = vector_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    if made is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, made.books.ravel().tolist())).encode()).hexdigest()
    rows = vector_codes.with_label_error(made.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans by kind and start."""
    found = personal.find_personal(table(spark, sf_dir, "documents", "doc_id", "text"))
    many = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{personal.KINDS[k]}")
    listed = personal.listed
    return found.select("doc_id", *map(many, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_added"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.restore_middle(middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text")))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_lines, op3_token_files, op4_quality, op5_substrings, op6_packing, op7_simhash, op8_secrets, op9_urls, op10_neighbours, op11_codes, op12_personal, op13_middle, pipeline)}
ORACLE_SQL = {"op4_quality": quality.SQL, "op9_urls": urls.SQL, "op13_middle": middle.SQL}
