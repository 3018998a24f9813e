"""The queries of problems 7 to 9 over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing, reading


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def _specs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return sorted((r.spec_name, r.capacity_tokens) for r in _table(spark, d, "pack_specs").collect())


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), _specs(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = _specs(spark, d)
    return packing.fill(packing.pack(_table(spark, d, "documents"), specs), specs)


def p7_bucket_fill(spark: SparkSession, d: str) -> DataFrame:
    """(spec_name, containers, fill) if batches keep to their length bucket, for comparison."""
    specs = _specs(spark, d)
    by = packing.fill(packing.pack(_table(spark, d, "documents"), specs, across=False), specs)
    return by.groupBy("spec_name").agg(F.count("*").alias("containers"), F.avg("fill").alias("fill"))


def p7_buckets(spark: SparkSession, d: str) -> DataFrame:
    return packing.bucket_report(_table(spark, d, "documents"), _specs(spark, d))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """(spec_name, texts, beyond, gaps): texts placed, containers over their capacity, texts whose pieces don't join on."""
    specs = _specs(spark, d)
    pieces = packing.pack(_table(spark, d, "documents"), specs)
    over = packing.fill(pieces, specs).groupBy("spec_name").agg(F.sum((F.col("fill") > 1).cast("long")).alias("beyond"))
    texts = pieces.groupBy("spec_name", "doc_id").agg(F.sum("n_tokens").alias("all"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("n"), F.max("piece").alias("last"))
    whole = texts.groupBy("spec_name").agg(F.count("*").alias("texts"), F.sum(((F.col("all") != F.col("end")) | (F.col("n") != F.col("last") + 1)).cast("long")).alias("gaps"))
    return whole.join(over, "spec_name").select("spec_name", "texts", "beyond", "gaps")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def _by_paper(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, d, "mix_targets")
    documents = mixing.memberships(_table(spark, d, "documents"), targets, "paper_key")
    return mixing.mix(documents, targets, sources=F.col("sources"))


def p8_paper_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture if a text may serve every source that published its paper, so that sources compete for it."""
    return _by_paper(spark, d)[0]


def p8_paper_shares(spark: SparkSession, d: str) -> DataFrame:
    return _by_paper(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_packed, p7_fill, p7_bucket_fill, p7_buckets, p7_coverage, p8_mix, p8_shares, p8_paper_mix, p8_paper_shares, p9_found, p9_levels)}
ORACLES: dict[str, str] = {
    "p7_coverage": "select spec_name, (select count(*) from documents) as texts, cast(0 as bigint) as beyond, cast(0 as bigint) as gaps from pack_specs",
}
