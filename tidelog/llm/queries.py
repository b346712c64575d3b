"""The queries of the text problems 7 to 9. None can be said in SQL: their tests are brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import encoding, mixing, packing, tokens
from tidelog.plans.storage import cut
from tidelog.plans.tables import table


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(tokens.sizes(table(spark, d, "documents"), copies=True), table(spark, d, "pack_bins"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(cut(p7_packed(spark, d), "packed"), table(spark, d, "pack_bins"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(cut(tokens.sizes(table(spark, d, "documents")), "sizes"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(cut(p8_mixture(spark, d), "mixture"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_packed, p7_fill, p8_mixture, p8_shares, p9_found, p9_restored)}
ORACLES: dict[str, str] = {}
