"""The queries of this subpackage: each reads its whole table and returns its operator's whole result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from citadine.llm import bpe, exact, licenses, mixing, near, pii, quality, runs, sharding, suffixes
from citadine.session import ready

TOKENIZERS = "/opt/tokenizers"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The file's place: the public_tokenizers package knows it, else the folder is taken."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return str(Path(TOKENIZERS) / name)
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, d: pii.op1(documents(spark, d)),
    "op2_line_dedup": lambda spark, d: runs.op2(documents(spark, d)),
    "op3_exact_dedup": lambda spark, d: exact.op3(documents(spark, d)),
    "op4_license_scan": lambda spark, d: licenses.op4(documents(spark, d)),
    "op5_mixing": lambda spark, d: mixing.op5(documents(spark, d)),
    "op6_ngram_jaccard": lambda spark, d: near.op6(documents(spark, d)),
    "op7_sharding": lambda spark, d: sharding.op7(documents(spark, d)),
    "op8_quality_rules": lambda spark, d: quality.op8(documents(spark, d)),
    "op9_bpe": lambda spark, d: bpe.op9(documents(spark, d), tokenizer()),
    "op10_substring_dedup": lambda spark, d: suffixes.op10(documents(spark, d)),
}

ORACLES: dict[str, str] = {"op2_line_dedup": runs.ORACLE, "op3_exact_dedup": exact.ORACLE}
