"""The queries of this package, one for each operator, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import read_table

WORD_BPE = "word_bpe_49k.json"


def tokenizer(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import packing

    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer())


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import near_dedup

    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import isolation

    return isolation.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import repeats

    return repeats.repeats(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import main_text

    return main_text.extract(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import contamination

    return contamination.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import token_counts

    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import ranking

    return ranking.held_out_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import chat

    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import language_model

    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import lines

    return lines.digests(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import hard_negatives

    # every seventh row gets the next label
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import turns

    rows = read_table(spark, sf_dir, "conversations")
    return turns.repair(turns.damaged(rows), rows.select("conv_id").distinct())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from loomgraph.llm import chat, contamination, hard_negatives, lines, turns

    return {
        "op6_decontamination": contamination.ORACLE_SQL,
        "op9_chat_formatting": chat.ORACLE_SQL,
        "op11_line_dedup": lines.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_conversation_repair": turns.ORACLE_SQL,
    }
