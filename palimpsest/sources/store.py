"""Version tables: published Parquet snapshots, JDBC databases, cold archives, and reads across tiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import arrow
from palimpsest.model import CHANGE, ENTITY, KEY, METADATA, RECORD, DuplicateVersion, NotFound, StorageError, cold_key
from palimpsest.operators.lifecycle import union_tiers
from palimpsest.sources.scratch import BUCKET, buckets_of, current, materialize, publish_buckets, read_buckets, vacuum, with_bucket

DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


class VersionStore:
    """Version records under one root, in buckets of entities; each write publishes a new snapshot in one step.

    Key: entity_type, entity_id, version. An append writes the new rows only and looks for their keys in their buckets;
    updates and deletions rewrite the buckets they touch. Writers are one at a time: of two, the second to publish fails.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def migrate(self) -> int:
        """Make the table if it isn't there; returns the snapshot's number."""
        return current(self.spark, self.root) or publish_buckets(self._bucketed(self.spark.createDataFrame([], RECORD)), self.root)

    def read(self, snapshot: int | None = None) -> DataFrame:
        return read_buckets(self.spark, self.root, snapshot).drop(BUCKET)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """As records are stored; what is missing is null, other columns stay out."""
        return with_bucket(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]), self.buckets, *ENTITY)

    def _touched(self, rows: DataFrame) -> tuple[list[int], DataFrame]:
        buckets = buckets_of(rows)
        return buckets, read_buckets(self.spark, self.root).where(F.col(BUCKET).isin(buckets))

    def append(self, records: DataFrame, strict: bool = False) -> int:
        """Add records. Keys that are there already are left out, or (``strict``) nothing is written and it raises.

        Of several records with one key the one created first is kept. The records are read three times; write them
        first where that is dear.
        """
        self.migrate()
        rows = self._bucketed(records)
        keys = rows.groupBy(*KEY, BUCKET).agg(F.count("*").alias("_n"))
        _, old = self._touched(rows)
        old = old.select(*KEY, BUCKET, F.lit(True).alias("_old"))
        if strict:
            if keys.join(old, [*KEY, BUCKET], "left").where("_n > 1 or _old").limit(1).count():
                raise DuplicateVersion("a version is there already")
            return publish_buckets(rows, self.root, added=True)
        rest = [f.name for f in RECORD.fields if f.name not in KEY]
        one = rows.groupBy(*KEY, BUCKET).agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("_r")).select(*KEY, "_r.*", BUCKET)
        return publish_buckets(one.join(old, [*KEY, BUCKET], "left_anti").select(*RECORD.fieldNames(), BUCKET), self.root, added=True)

    def update(self, records: DataFrame, columns: tuple[str, ...] = ("data", "hash", "previous_hash", "metadata", "strategy", "delta")) -> int:
        """Replace columns of existing records by key; raises if a key isn't there."""
        columns = tuple(c for c in columns if c in records.columns)
        new = materialize(with_bucket(records.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in columns]), self.buckets, *ENTITY), "update")
        touched, old = self._touched(new)
        if new.join(old.select(*KEY, BUCKET), [*KEY, BUCKET], "left_anti").limit(1).count():
            raise NotFound("a version to update isn't there")
        joined = old.join(new.withColumn("_hit", F.lit(True)), [*KEY, BUCKET], "left")
        out = joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
        return publish_buckets(out, self.root, replaced=touched)

    def delete(self, condition: Column) -> int:
        """Take out the records for which the condition is true."""
        gone = F.coalesce(condition, F.lit(False))
        touched = buckets_of(read_buckets(self.spark, self.root).where(gone))
        return publish_buckets(read_buckets(self.spark, self.root).where(F.col(BUCKET).isin(touched) & ~gone), self.root, replaced=touched)

    def tidy(self) -> int:
        """Write each bucket that lies in several parts anew, in one."""
        rows = read_buckets(self.spark, self.root)
        return publish_buckets(rows, self.root, replaced=buckets_of(rows))

    def vacuum(self, keep: int = 1) -> int:
        """Delete parts that only snapshots before the last ``keep`` hold."""
        return vacuum(self.spark, self.root, keep)


def jdbc_options(kind: str, url: str, table: str, **more: str) -> dict[str, str]:
    if kind not in DRIVERS:
        raise StorageError(f"no driver for {kind}")
    return {"url": url, "dbtable": table, "driver": DRIVERS[kind], "fetchsize": "10000"} | more


def read_jdbc(spark: SparkSession, options: dict[str, str], column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """Version records of a database table; metadata that comes as JSON text is parsed, bad JSON fails the read.

    ``column`` and ``bounds`` split the read. Needs the database's driver on the class path.
    """
    more = {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)} if column and bounds else {}
    return decode(spark.read.format("jdbc").options(**options, **more).load())


def write_jdbc(df: DataFrame, options: dict[str, str]) -> None:
    encode(df).write.format("jdbc").options(**options).mode("append").save()


def encode(df: DataFrame) -> DataFrame:
    """Records as rows of a flat table: metadata and delta as JSON, times to the microsecond."""
    return df.withColumns({c: F.to_json(c, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) for c in ("metadata", "delta") if c in df.columns and df.schema[c].dataType.typeName() != "string"})


def decode(df: DataFrame) -> DataFrame:
    out = df
    if df.schema["metadata"].dataType.typeName() == "string":
        out = out.withColumn("metadata", F.from_json("metadata", METADATA, {"mode": "FAILFAST"}))
    if "delta" in df.columns and df.schema["delta"].dataType.typeName() == "string":
        from pyspark.sql.types import ArrayType

        out = out.withColumn("delta", F.from_json("delta", ArrayType(CHANGE), {"mode": "FAILFAST"}))
    return out


class ColdStore:
    """Archived payloads by key ``type/id/version``, in zstd Parquet parted by type."""

    def __init__(self, spark: SparkSession, root: str, compression: str = "zstd"):
        self.spark, self.root, self.compression = spark, root, compression

    def put(self, records: DataFrame) -> None:
        key = cold_key(F.col("entity_type"), F.col("entity_id"), F.col("version"))
        records.select("entity_type", key.alias("key"), "data").write.partitionBy("entity_type").option("compression", self.compression).mode("append").parquet(self.root)

    def read(self) -> DataFrame:
        """(entity_type, entity_id, version, data) of all payloads; those archived more than once come once."""
        rows = self.spark.read.parquet(self.root).dropDuplicates(["entity_type", "key"])
        # an id may hold slashes, the type's length is known and the version is last
        rest = F.substring(F.col("key"), F.length("entity_type") + 2, F.length("key"))
        version = F.substring_index(rest, "/", -1)
        return rows.select("entity_type", F.substring(rest, F.lit(1), F.length(rest) - F.length(version) - 1).alias("entity_id"), version.cast("long").alias("version"), "data")

    def get(self, entity_type: str, entity_id: str, version: int) -> DataFrame:
        """The payload; the type prunes partitions, the key row groups."""
        return self.spark.read.parquet(self.root).where((F.col("entity_type") == entity_type) & (F.col("key") == f"{entity_type}/{entity_id}/{version}")).select("data").distinct()


OBJECT = "entity_type string, entity_id string, version long, data string"


def _opener(compression: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("content").to_pylist()
            texts = [pa.input_stream(pa.py_buffer(x), compression=compression).read().decode() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("entity_type", "entity_id", "version")] + [arrow.array(texts, pa.string())], ["entity_type", "entity_id", "version", "data"])

    return run


def read_objects(spark: SparkSession, root: str, entity_type: str = "*", entity_id: str = "*", version: int | str = "*", compression: str | None = None) -> DataFrame:
    """OBJECT rows of single archived objects ``type/id/version`` of a bucket: each holds one payload, ``compression``: as it was put (zstd, gzip, ...).

    What is named goes into the listing. Objects that can't be opened fail the read; names with other levels aren't seen.
    """
    parts = F.slice(F.split("path", "/"), -3, 3)
    found = spark.read.format("binaryFile").load(f"{root}/{entity_type}/{entity_id}/{version}")
    named = found.select(F.url_decode(parts[0]).alias("entity_type"), F.url_decode(parts[1]).alias("entity_id"), parts[2].try_cast("long").alias("version"), "content").where("version is not null")
    return named.mapInArrow(_opener(compression), OBJECT)


class Router:
    """Writes to the main store, and to the analytics store as far as it is up; reads from either or both."""

    def __init__(self, main: VersionStore, analytics: VersionStore | None = None):
        self.main, self.analytics = main, analytics
        self.errors: list[Exception] = []

    def append(self, records: DataFrame) -> int:
        n = self.main.append(records)
        if self.analytics:
            try:
                self.analytics.append(records)
            except Exception as e:  # the main write stands
                self.errors.append(e)
        return n

    def read_main(self) -> DataFrame:
        return self.main.read()

    def read_analytics(self) -> DataFrame:
        return self.analytics.read() if self.analytics else self.main.read().limit(0)

    def read(self) -> DataFrame:
        return union_tiers(self.main.read(), self.analytics.read()) if self.analytics else self.main.read()
