"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cantiere.llm import byte_bpe, chat, decontaminate, jaccard, language, packing, prefix_trie, quality, runs, secrets, token_files, toxicity, warc
from cantiere.llm.common import table


def op1_perspective_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(table(spark, sf, "conversations"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf, "labels")))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.assess(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_language_filters(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"), secrets.train(secrets.examples(spark)))


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.components(table(spark, sf, "documents"))


def op10_warc_salvage(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.digests(table(spark, sf, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ENTRIES = {
    "op1_perspective_rotation": (op1_perspective_rotation, chat.ROTATE_SQL),
    "op2_quality_rules": (op2_quality_rules, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_language_filters": (op4_language_filters, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_token_files": (op7_token_files, None),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_jaccard_join": (op9_jaccard_join, jaccard.COMPONENTS_SQL),
    "op10_warc_salvage": (op10_warc_salvage, warc.ROUND_TRIP_SQL),
    "op11_prefix_trie": (op11_prefix_trie, prefix_trie.NODES_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_best_fit_packing": (op13_best_fit_packing, None),
}
