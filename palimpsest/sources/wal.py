"""Write-ahead logs: staged records that are acknowledged once they are stored.

As tables, what is open is entries without an acknowledgement. The file form is a run of frames, each a 4-byte big-endian
length, that many bytes of JSON and their CRC-32, beside a text file with one acknowledged id a line.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import arrow
from palimpsest.model import KEY, WALError
from palimpsest.sources.scratch import BUCKET, current, materialize, publish_buckets, read_buckets, with_bucket

# Fixed value: frames beyond this size end a file.
LARGEST = 100 * 1024 * 1024
ENTRY = "id string, record string, created_at string"


def unacknowledged(entries: DataFrame, acks: DataFrame, order: str = "created_at") -> DataFrame:
    """Entries whose id isn't acknowledged; replay them in ``order``."""
    return entries.join(acks.select("id").distinct(), "id", "left_anti")


def recover(open_entries: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to store, (id, outcome) to acknowledge): outcome is ``skipped`` if the version is stored, else ``replayed``.

    Of several entries for one version the first by id is replayed, the others are skipped.
    """
    there = stored.select(*KEY, F.lit(True).alias("_there")).distinct()
    rest = [c for c in open_entries.columns if c not in KEY]
    first = open_entries.groupBy(*KEY).agg(F.min("id").alias("_first"))
    marked = open_entries.join(there, KEY, "left").join(first, KEY)
    outcome = F.when(F.col("_there") | (F.col("id") != F.col("_first")), "skipped").otherwise("replayed")
    marked = marked.withColumn("outcome", outcome)
    return marked.where("outcome = 'replayed'").select(*KEY, *rest), marked.select("id", "outcome")


def recover_counts(open_entries: DataFrame, stored: DataFrame) -> DataFrame:
    return recover(open_entries, stored)[1].groupBy("outcome").agg(F.count("*").alias("entries"))


# Fixed value: the layout of a frame (length, JSON, CRC-32; big-endian).
def frame(entry: dict) -> bytes:
    body = json.dumps(entry, ensure_ascii=False, separators=(",", ":")).encode()
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def frames(raw: bytes) -> Iterator[dict]:
    """Entries of a log file; it ends at a frame that is cut off or too long; frames that are damaged are left out."""
    at = 0
    while at + 4 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        if size > LARGEST or at + 8 + size > len(raw):
            return
        body = raw[at + 4 : at + 4 + size]
        (crc,) = struct.unpack_from(">I", raw, at + 4 + size)
        at += 8 + size
        if crc == zlib.crc32(body):
            try:
                value = json.loads(body)
            except ValueError:
                continue
            if isinstance(value, dict):
                yield value


class FileLog:
    """A log file on the driver's disk and its acknowledgements, for a writer of its own records."""

    def __init__(self, path: str):
        self.path, self.ack_path = path, f"{path}.ack"
        self._log, self._acks = open(path, "ab"), open(self.ack_path, "a", encoding="utf-8")

    def append(self, entry: dict) -> None:
        """The entry is on disk when this returns."""
        if not entry.get("id"):
            raise WALError("an entry needs an id")
        self._log.write(frame(entry))
        self._log.flush()
        os.fsync(self._log.fileno())

    def ack(self, entry_id: str) -> None:
        self._acks.write(f"{entry_id}\n")
        self._acks.flush()

    def replay(self) -> list[dict]:
        """Entries that are not acknowledged, in order of writing."""
        with open(self.ack_path, encoding="utf-8") as f:
            done = {line.strip() for line in f}
        with open(self.path, "rb") as f:
            return [e for e in frames(f.read()) if str(e.get("id", "")) not in done]

    def close(self) -> None:
        self._log.close()
        self._acks.close()


class TableLog:
    """A log as a staging table on shared storage: entries and acknowledgements, each write one published part.

    Writers of either kind are one at a time. ``purge`` drops what is acknowledged.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _write(self, name: str, rows: DataFrame, **how) -> None:
        publish_buckets(with_bucket(rows, self.buckets, "id"), f"{self.root}/{name}", **({"added": True} | how))

    def _read(self, name: str, kind: str) -> DataFrame:
        root = f"{self.root}/{name}"
        return read_buckets(self.spark, root) if current(self.spark, root) else with_bucket(self.spark.createDataFrame([], kind), self.buckets, "id")

    def append(self, entries: DataFrame) -> None:
        """Entries (ENTRY) are stored when this returns."""
        if entries.where(F.coalesce(F.trim("id"), F.lit("")) == "").limit(1).count():
            raise WALError("an entry needs an id")
        self._write("entries", entries.select("id", "record", "created_at"))

    def ack(self, ids: DataFrame) -> None:
        self._write("acks", ids.select("id"))

    def replay(self) -> DataFrame:
        """Entries that are not acknowledged; repeated ones once. Sort them by created_at to store them in order."""
        entries, acks = self._read("entries", ENTRY), self._read("acks", "id string")
        return entries.dropDuplicates(["id", BUCKET]).join(acks.select("id", BUCKET).distinct(), ["id", BUCKET], "left_anti").select("id", "record", "created_at")

    def purge(self) -> int:
        """Rewrite the log without acknowledged entries; returns how many are left."""
        left = materialize(self.replay(), "replay")
        self._write("entries", left, added=False)
        self._write("acks", self.spark.createDataFrame([], "id string"), added=False)
        return left.count()


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(str(e.get("id", "")), json.dumps(e.get("record"), ensure_ascii=False), str(e.get("created_at", ""))) for raw in batch.column("content").to_pylist() for e in frames(raw)]
        yield arrow.batch(rows, arrow.schema(ENTRY))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ENTRY of log files, a task a file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, ENTRY)


def read_acks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
