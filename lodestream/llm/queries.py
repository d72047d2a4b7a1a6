"""Queries of the problems of this subpackage (p4, p7, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import byte_bpe, entity_match, packing, place_map, reading_level
from lodestream.runtime import load


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.match_entities(load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "tracked_company"), load(spark, sf_dir, "hq_place"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("discovery_company_id", "tracked_company_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_map.match_places(load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "hq_place")).select("discovery_company_id", "place_id")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_map.unmatched_report(load(spark, sf_dir, "discovery_company"), load(spark, sf_dir, "hq_place"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(load(spark, sf_dir, "documents"))


#: Tokens of one container.
CAPACITY = 2048


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(byte_bpe.count_tokens(load(spark, sf_dir, "documents")), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf_dir), CAPACITY)


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.demanding_documents(p10_levels(spark, sf_dir))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.level_profile(p10_levels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p4_found, p4_matches, p7_found, p7_unmatched, p8_ids, p9_containers, p9_fill, p10_found, p10_levels, p10_profile)}
ORACLES: dict[str, str] = {}
