"""The queries of this subpackage: name to function of (spark, sf_dir), and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jaccard_join import jaccard_components
from .lm_score import deleted_interpolation_scores
from .mixing import mix_sources
from .packing import pack_documents
from .perplexity_rules import quality_rules
from .ranked_search import ORACLE as RANKED_SQL
from .ranked_search import ranked_search
from .revisits import ORACLE as REVISITS_SQL
from .revisits import captures_of_pages, header_text, resolve_revisits
from .site_quality import site_quality
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_file import token_file_digest
from .topk_search import topk_search
from .toxicity import toxicity_scores


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures, and the text that stays (bytes of characters cut in two as replacement characters)."""
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept", "spans")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation_scores(table(spark, sf_dir, "documents"), order=2, folds=7, held=2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, mix = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    # the words of what the shards hold, not of what was planned
    held = mix.groupBy("doc_id", "k").agg(F.count("*").alias("times"))
    rows = plan.groupBy("doc_id", "k", "size", "source_size", "target").agg(F.count("*").alias("rows"))
    mixed = rows.join(held, (rows["doc_id"].eqNullSafe(held["doc_id"])) & (rows["k"] == held["k"]), "left").select(rows["doc_id"], "size", "source_size", "target", F.coalesce(F.col("size") * F.col("times"), F.lit(0)).alias("taken"), "rows")
    each = mixed.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.expr("taken div rows") + F.when(F.col("nth") == 1, F.col("taken") % F.col("rows")).otherwise(0)).alias("taken"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source."""
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages"))).withColumn("headers", header_text(F.col("headers")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_site_quality": op3_site_quality,
    "op4_perplexity_rules": op4_perplexity_rules,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_topk_search": op7_topk_search,
    "op8_revisits": op8_revisits,
    "op9_mixing": op9_mixing,
    "op10_lm_score": op10_lm_score,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_file": op12_token_file,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op8_revisits": REVISITS_SQL, "op11_ranked_search": RANKED_SQL}
