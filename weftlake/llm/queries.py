"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlake.llm.board import REPORT_SQL as BOARD_SQL
from weftlake.llm.board import board_report
from weftlake.llm.bpe import bpe_report
from weftlake.llm.common import documents
from weftlake.llm.exact_dedup import exact_duplicates
from weftlake.llm.langid import language_report
from weftlake.llm.line_dedup import line_report
from weftlake.llm.lm import score_report
from weftlake.llm.main_text import main_text_report
from weftlake.llm.mixing import mix_report
from weftlake.llm.prefix_trie import REPORT_SQL as TRIE_SQL
from weftlake.llm.prefix_trie import trie_report
from weftlake.llm.quality import REPORT_SQL, quality_report
from weftlake.llm.recompression import repeat_report
from weftlake.llm.sharding import shard_by_bytes
from weftlake.llm.simhash import simhash_report


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_report(documents(spark, sf_dir))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def op4_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir))


def op5_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir), runs=True)


def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op9_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_board_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board_report(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sale_lines", "vendors", "items")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sampled_splitters": op1_sampled_splitters,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_host_quality": op3_host_quality,
        "op4_rank_order": op4_rank_order,
        "op5_bpe_lexicon": op5_bpe_lexicon,
        "op6_recompression": op6_recompression,
        "op7_line_chunks": op7_line_chunks,
        "op8_bloom_dedup": op8_bloom_dedup,
        "op9_raked_mix": op9_raked_mix,
        "op10_simhash_mih": op10_simhash_mih,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_line_blocks": op12_line_blocks,
        "op13_board_feed": op13_board_feed,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_host_quality": REPORT_SQL,
        "op11_prefix_trie": TRIE_SQL,
        "op13_board_feed": BOARD_SQL,
        "op8_bloom_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    }
