"""One query for each operator, with production parameters, over whole tables; and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, hmm, langid, lexical, licenses, neighbours, packing, quality, rules, segment, spelling, warc
from .common import id_remainder, new_path
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    sample = quality.labelled_sample(docs.filter(~held_out), _table(spark, sf_dir, "labels").filter(~held_out))
    model = quality.fit(sample)
    x = quality.with_quality(docs.select("doc_id", "text"), model)
    return x.select("doc_id", held_out.alias("held_out"), "quality_score.score", "quality_score.predicted")


def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    x = langid.predict_languages(docs, docs.filter(~held_out))
    return x.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.phrases_per_char")


def op4_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op5_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    x = segment.decode(segment.encode(_table(spark, sf_dir, "documents"), model), model)
    return x.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "quality_rules.*")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(pages, path := new_path(spark, "warc"))
    x = warc.read_archives(spark, path)
    as_id = lambda c: F.col(c).cast(pages.schema["page_id"].dataType).alias(c)
    return x.select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 7) == 2
    x = hmm.fit_and_score(_table(spark, sf_dir, "documents"), ~held_out)
    return x.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    found = F.col("contamination")
    listed = F.sha2(F.array_join(found["items"], ",").cast("binary"), 256)
    return x.select("doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"), listed.alias("items_sha256"), (found["n_hit"] > 0).alias("contaminated"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def unigram_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op10, which SQL can express, from the operator with one state and without training rounds."""
    held_out = id_remainder("doc_id", 7) == 2
    x = hmm.fit_and_score(_table(spark, sf_dir, "documents"), ~held_out, states=1, rounds=0)
    return x.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [
        op1_vector_neighbours, op2_compression_quality, op3_cross_parsing_language, op4_license_paragraphs, op5_sampled_segmentations,
        op6_pattern_packing, op7_order_minhash, op8_adaptive_rules, op9_warc_archives, op10_hidden_markov, op11_spelling_variants, op12_decontamination,
        op13_lexical_search, unigram_base_scores, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others depend on a trained model or sampling: tests hold brute force against them."""
    return dict(ORACLES)
