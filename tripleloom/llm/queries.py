"""The operators over the test tables, one query each, with the answer in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import scratch_path

from . import answers, ppm, url_filter
from .decontaminate import decontaminate
from .fingerprints import fingerprints_and_classes
from .language import held_out, identify, train
from .near_dup import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie
from .simhash import simhash_components
from .suffix_dedup import remove_repeated_bytes
from .token_files import read_tokens, write_tokens
from .url_filter import Rule
from .whitening import whiten
from .window_dedup import remove_repeats

RULES = (
    Rule(url_filter.BLOCK, "net/"),
    Rule(url_filter.ALLOW, "example.net/en/"),
    Rule(url_filter.BLOCK, "example.com/de/"),
    Rule(url_filter.ALLOW, "org/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_and_path(F.coalesce("url", F.lit("")))
    # The labels are the URLs that rules decide.
    ruled = pages.withColumn("rule", url_filter.deciding_rule(host, path, RULES)).where("rule is not null")
    model = url_filter.train(ruled.select("url", (F.col("rule.verdict") == url_filter.BLOCK).alias("blocked")))
    return url_filter.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    return ppm.scores(docs.withColumn("held_out", out), docs.where(~out)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_classes(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: function for name, function in sorted(globals().items()) if name.startswith("op") and callable(function)
}

#: The other queries hold what a tokenizer, a trained model or a permutation hash decides; tests hold them against brute
#: force, exact round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": answers.DECONTAMINATION,
    "op3_substring_dedup": answers.SUBSTRING_DEDUP,
    "op4_near_dedup": answers.NEAR_DEDUP,
    "op8_suffix_dedup": answers.SUFFIX_DEDUP,
    "op13_prefix_trie": answers.PREFIX_TRIE,
}
