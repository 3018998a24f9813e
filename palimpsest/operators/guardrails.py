"""Tenant scopes and size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TENANT = "tenant_id"


def tenant_scope(df: DataFrame, tenant: str | None) -> DataFrame:
    """Only the tenant's records; all of them for None or ''. A filter, so pages are taken of what is left."""
    return df.where(F.element_at("metadata.custom", TENANT) == tenant) if tenant else df


def split_by_size(df: DataFrame, max_entity: int = 0, max_metadata: int = 0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``): data or metadata of strictly more bytes than the limit; 0 is no limit.

    Metadata is looked at first. Before numbering: a refused state must not be the predecessor of an accepted one.
    """
    error = F.lit(None).cast("string")
    if max_entity > 0:
        error = F.when(F.octet_length("data") > max_entity, "entity too large").otherwise(error)
    if max_metadata > 0 and "metadata" in df.columns:
        error = F.when(F.octet_length(F.to_json("metadata")) > max_metadata, "metadata too large").otherwise(error)
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
