"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, encoding, history, mixing, near_notes, neighbours, pages, sentences, set_pairs
from quernstone.tables import load, ship


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.articles(load(spark, sf_dir, "url_extracts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.spam_pages(load(spark, sf_dir, "url_extracts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoding.repair(load(spark, sf_dir, "url_extracts")).select("page_id", "field")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoding.repair(load(spark, sf_dir, "url_extracts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return history.found(load(spark, sf_dir, "dedup_features"), load(spark, sf_dir, "incoming_notes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return set_pairs.found(load(spark, sf_dir, "discovery_index"), load(spark, sf_dir, "notes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neighbours.found(load(spark, sf_dir, "embedding_cache"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_notes.found(load(spark, sf_dir, "notes"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(load(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents, each with its repeats and its source's shares."""
    ship(spark)
    drawn, shares = mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))
    return drawn.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentences.sentence_ends(load(spark, sf_dir, "documents").where("doc_id is not null"))


FOUND = [p1_found, p2_found, p2_restored, p3_found, p4_found, p5_found, p6_found, p7_found, p8_ids, p9_mix, p9_shares, p10_found]


def queries():
    return {f.__name__: f for f in FOUND}


def oracle_sql() -> dict[str, str]:
    return {}
