"""Queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigraph.llm import audit, decontaminate, extract, jaccard, lattice, licenses, mixing, quality, repeats, simhash, surrogates, toxicity
from verdigraph.staging import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(_read(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.digest(_read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(_read(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE, "op7_mixing": mixing.ORACLE, "op12_filter_audit": audit.ORACLE}
