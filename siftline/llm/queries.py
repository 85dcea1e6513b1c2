"""The operators' queries over the whole tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blocks, exact, language, lines, mixing, near, periods, phrases, pieces, private, rules, sharding, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str = "") -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pieces")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op2_exact", exact.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


@query("op4_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cascade(table(spark, sf_dir, "documents"))


@query("op8_blocks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op7_warc", warc.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op10_near")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.clusters(table(spark, sf_dir, "documents"))


@query("op6_private")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(table(spark, sf_dir, "documents"))


@query("op11_periods")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary(periods.annotate(periods.with_planted_periods(table(spark, sf_dir, "documents"))))


@query("op12_phrases", phrases.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_lines", lines.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))
