"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordinalis.llm import encode, groups, langid, mixing, neardup, overlap, pii, reading, vecsearch
from ordinalis.sources.tables import canonical_id, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.match_groups(table(spark, folder, "match_pairs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.train_items(table(spark, folder, "train"))


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    train = table(spark, folder, "train").select(canonical_id("PetID").alias("petid"), "Description").distinct()
    return pii.masked(train, "petid", "Description")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found(*(table(spark, folder, t) for t in ("train", "test", "image_index")))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(*(table(spark, folder, t) for t in ("train", "test", "image_index")))


def p3_cover(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.coverage(table(spark, folder, "train"), table(spark, folder, "test"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.train_pairs(table(spark, folder, "train"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.train_groups(table(spark, folder, "train"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return vecsearch.found(table(spark, folder, "probe_photos"), {e: table(spark, folder, f"{e}_img_emb") for e in ("clip", "siglip")})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.found(table(spark, folder, "train"))


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    return langid.relabelled(table(spark, folder, "train"))


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.documents(table(spark, folder, "train"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.document_ids(table(spark, folder, "documents"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels")).select("doc_id", "band")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return reading.profile(documents, reading.reading_levels(documents, table(spark, folder, "reading_labels")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_masked, p3_found, p3_report, p3_cover, p4_found, p4_groups, p5_found, p6_found, p6_spans, p6_documents, p7_ids, p8_mix, p8_shares, p9_found, p9_profile)}
