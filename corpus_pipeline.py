"""A corpus pipeline of four operators: quality rules, language, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioprofile.llm import dedup, langid, packing, rules
from regioprofile.llm.common import id_remainder, written

#: A language counts as recognised from this score on; the score is a posterior over the learned languages.
SURE = 0.5
#: A text fits its language up to FACTOR times the phrases per character that this share of the language's labelled texts
#: outside the training rows stay within.
FIT_QUANTILE, FIT_FACTOR = 0.99, 1.3


def _free(docs: DataFrame, name: str) -> str:
    """A name for a further column that docs has not."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or an adaptive cutoff of their language and source.

    Null and empty texts have no words and go; a measure equal to its cutoff is within it; null languages and sources
    are groups of their own; repeated rows stay or go together; texts of any length count whole. Columns of docs keep
    their names and values, whatever these are; an empty table stays empty.
    """
    verdict = _free(docs, "quality_rules")
    x = rules.quality_rules(docs, into=verdict)
    return x.filter(F.col(f"{verdict}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language or that don't fit the likeliest one; learns from the labelled ones.

    The score only compares learned languages. A text in none of them falls into many short phrases of each, so it is
    held against labelled texts of that language that went into no automaton. Without any such text nothing is known of
    the fit, and the score alone decides. Null and empty texts and those without a letter have no language and go, ties
    of two languages stay; repeated rows stay or go together; texts of any length are parsed whole. Columns of docs keep
    their names and values, whatever these are; without labels, as in an empty table, nothing is recognised.
    """
    into = _free(docs, "language")
    of = lambda field: F.col(f"{into}.{field}")
    held_out = id_remainder("doc_id", 4) == 2
    samples = langid.language_samples(docs.filter(~held_out))
    known = langid.with_language(docs.filter(held_out & F.col("lang").isNotNull()), samples, into=into)
    found = known.filter(F.col("lang") == of("lang_pred")).groupBy("lang")
    limits = found.agg(F.percentile_approx(of("phrases_per_char"), FIT_QUANTILE).alias("q")).collect()  # a row for each learned language
    limit = F.lit(None).cast("double")
    for lang, q in limits:
        limit = F.when(of("lang_pred") == lang, FIT_FACTOR * q).otherwise(limit)
    x = langid.with_language(docs, samples, into=into)
    sure = (of("lang_pred") != "und") & (of("score") >= SURE)
    return x.filter(sure & F.coalesce(of("phrases_per_char") <= limit, F.lit(True))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Null, empty and wordless texts are copies of nothing. Of rows that repeat the id that is kept, each different text
    stays once; of rows of null id one stays for each group without an id. Texts of any length are compared whole. Columns of docs keep their names and
    values, whatever these are; an empty table stays empty.
    """
    return dedup.without_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 4096 tokens.

    A null text counts as empty, of which the end token is packed; longer texts are cut; each repeated row is packed.
    Of docs only id and text are used; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Learned models, sketches and alignment have no SQL form; tests hold brute-force versions against each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
