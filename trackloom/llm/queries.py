"""Queries of the operators in this package: name -> (session, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, sized
from ..sources.tables import table
from . import packing, quantiles, runs, tokens, truncation


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_runs(spark, sf).select("track_id", "start_frame", "end_frame")


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf, "points"), table(spark, sf, "clips"))


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.speed_percentiles(table(spark, sf, "points"), table(spark, sf, "clips"))


def p2_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.within_bound(table(spark, sf, "points"), table(spark, sf, "clips"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.document_ids(table(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per pack size: how many containers, tokens and split texts, and the share of the room used."""
    packs = table(spark, sf, "pack_sizes").select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    per = p7_containers(spark, sf).groupBy("pack_id", "container_id").agg(F.sum("length").alias("used"), F.sum((F.col("piece") == 1).cast("long")).alias("split"))
    per = per.groupBy("pack_id").agg(F.sum((F.col("used") > 0).cast("long")).alias("containers"), F.sum("used").alias("tokens"), F.sum("split").alias("split_texts"))
    return per.join(sized(packs), "pack_id").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per pack size what must be nothing: overlaps, gaps, containers beyond their room, texts split that needn't be,
    documents not placed whole; and whether the containers are the least possible number."""
    documents, packs = table(spark, sf, "documents"), table(spark, sf, "pack_sizes").select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    placed = cut_lineage(packing.packed_documents(documents, table(spark, sf, "pack_sizes")))
    held = placed.where("length > 0").withColumn("before", F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("pack_id", "container_id").orderBy("start")))
    wrong = held.groupBy("pack_id", "container_id").agg(F.sum((F.col("start") < F.coalesce("before", F.lit(0))).cast("long")).alias("overlaps"), F.sum((F.col("start") > F.coalesce("before", F.lit(0))).cast("long")).alias("gaps"), F.sum("length").alias("used"))
    per = wrong.join(sized(packs), "pack_id").groupBy("pack_id", "capacity").agg(F.sum("overlaps").alias("overlaps"), F.sum("gaps").alias("gaps"), F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("beyond"), F.count("*").alias("n"), F.sum("used").alias("tokens"))
    sizes = packing.document_lengths(documents, "byte_bpe_50k").groupBy("doc_id").agg(F.sum("length").alias("whole"), F.count("*").alias("copies"))
    texts = placed.groupBy("pack_id", "doc_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces")).join(sizes, "doc_id", "full").join(sized(packs), "pack_id", "left")
    texts = texts.groupBy("pack_id").agg(
        F.sum((F.col("pieces") > F.when(F.col("whole") <= F.col("capacity"), F.col("copies")).otherwise(F.ceil(F.col("whole") / F.col("capacity")) + F.col("copies") - 1)).cast("long")).alias("split"),
        F.sum((~F.col("length").eqNullSafe(F.col("whole"))).cast("long")).alias("not_whole"),
    )
    return per.join(texts, "pack_id").select("pack_id", "overlaps", "gaps", "beyond", "split", "not_whole", (F.col("n") == F.ceil(F.col("tokens") / F.col("capacity"))).alias("least"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_documents(table(spark, sf, "documents"))


def p8_at_limit(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.documents_at_limit(table(spark, sf, "documents"))


def p8_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the rule that found it."""
    return truncation.classified(table(spark, sf, "documents")).where("truncated").select("doc_id", "by").distinct()


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p2_percentiles, p2_within_bound, p6_ids, p7_containers, p7_fill, p7_checked, p8_found, p8_at_limit, p8_by_rule, p8_rates)}
