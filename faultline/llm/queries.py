"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import alignment, classifier, fingerprints, mixing, preferences, private_data, quality_rules, set_join, sharding, spelling, substrings, token_files, unigram
from faultline.llm.labels import held_out
from faultline.llm.oracles import oracles as oracles
from faultline.llm.shared import documents
from faultline.session import cut


def op1_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(documents(spark, sf_dir), fingerprints.BOUNDED)


def op2_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, documents(spark, sf_dir), sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    index = token_files.write_tokens(docs, vocabulary, token_files.token_folder(docs))
    return token_files.read_tokens(index)


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.score_documents(spark, documents(spark, sf_dir), sf_dir)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= classifier.CUTOFF).cast("int").alias("predicted"),
    )


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = preferences.format_preferences(preferences.with_foreign_replies(preferences.conversations_of(turns)))
    text = lambda mask: F.array_join(
        F.transform(mask, lambda r: F.concat(r["length"].cast("string"), F.lit(":"), r["train"].cast("int").cast("string"))), ","
    )
    return pairs.withColumns({c: text(c) for c in ("chosen_mask", "rejected_mask")})


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(documents(spark, sf_dir))


def op10_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(documents(spark, sf_dir))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of both vocabularies for every row of documents; see ``alignment.align``."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), *paths, size_b=32_000)


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots; see ``spelling.variants``."""
    return spelling.variants(cut(spelling.word_counts(documents(spark, sf_dir))))


def op13_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of documents; see ``private_data.find``. The counts are of base spans."""
    docs = documents(spark, sf_dir)
    return private_data.digest(private_data.find(docs, private_data.fit(docs)))


def queries() -> dict:
    return {
        "op1_paragraph_sketches": op1_paragraph_sketches,
        "op2_certified_rules": op2_certified_rules,
        "op3_token_files": op3_token_files,
        "op4_fair_mix": op4_fair_mix,
        "op5_minimax_shards": op5_minimax_shards,
        "op6_unigram_pieces": op6_unigram_pieces,
        "op7_quadratic_discriminant": op7_quadratic_discriminant,
        "op8_preference_pairs": op8_preference_pairs,
        "op9_super_kmers": op9_super_kmers,
        "op10_heavy_light_join": op10_heavy_light_join,
        "op11_pair_bitmaps": op11_pair_bitmaps,
        "op12_trie_pairs": op12_trie_pairs,
        "op13_weak_labels": op13_weak_labels,
    }
