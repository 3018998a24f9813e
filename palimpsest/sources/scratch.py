"""Tables written between the steps of an operator, and snapshots that appear all at once.

Everything goes below the shared folder of ``spark.checkpoint.dir``; only where that is unset and all tasks run on this
machine (tests) an own folder is made. Written tables cut the lineage: a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
        _written.append((spark, at))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a written table."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release() -> None:
    """Delete what this process wrote. Runs at exit; DataFrames over those tables can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:
            pass


atexit.register(release)


def publish(df: DataFrame, root: str) -> int:
    """Make the rows the current snapshot of ``root`` in one step; returns its number.

    The rows are written to a folder no reader looks at; then a pointer file with the number takes its name by a
    rename, which either happens or not. Readers see the old snapshot or the new one, never a mixture; a failed writer
    leaves the old one current. Two writers of one number: the second rename fails.
    """
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{root}/{data}")
    return _point(spark, root, (current(spark, root) or 0) + 1, data)


def write_bytes(spark: SparkSession, path: str, raw: bytes):
    fs, p = _fs(spark, path)
    stream = fs.create(p)
    stream.write(bytearray(raw))
    stream.close()
    return p


def _point(spark: SparkSession, root: str, number: int, text: str) -> int:
    staged = write_bytes(spark, f"{root}/.staged-{uuid.uuid4().hex}", text.encode())
    fs, final = _fs(spark, f"{root}/current-{number:010d}")
    if fs.exists(final) or not fs.rename(staged, final):
        raise RuntimeError(f"snapshot {number} of {root} was published by another writer")
    return number


BUCKET = "_bucket"


def with_bucket(df: DataFrame, buckets: int, *by: str | Column) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))


def materialize_buckets(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` in a folder for each bucket, so that a filter on BUCKET reads only its folders."""
    path = new_path(df.sparkSession, name)
    df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_of(df: DataFrame) -> list[int]:
    """The buckets that rows lie in; no more than there are buckets."""
    return sorted(r[0] for r in df.select(BUCKET).distinct().collect())


def publish_buckets(df: DataFrame, root: str, replaced: list[int] | None = None, added: bool = False) -> int:
    """Make rows (with BUCKET) part of a new snapshot in one step; only they are written.

    ``replaced``: these buckets' older rows are no longer in the snapshot (None, unless ``added``: all older rows).
    ``added``: the rows come to the older ones. A snapshot is a list of parts with their live buckets, in its
    pointer file, so what a publication costs grows with its rows and the buckets it replaces, not with the table.
    """
    spark = df.sparkSession
    old = _manifest(spark, root) if current(spark, root) else None
    part = uuid.uuid4().hex
    df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{root}/part={part}")
    fs, folder = _fs(spark, f"{root}/part={part}")
    live = sorted(int(x.rpartition("=")[2]) for x in (s.getPath().getName() for s in fs.listStatus(folder)) if x.startswith(BUCKET))
    parts = []
    if old is not None and (replaced is not None or added):
        for p, buckets, whole in old["parts"]:
            left = [b for b in buckets if b not in set(replaced or ())]
            parts += [[p, left, whole and left == buckets]] if left else []
    parts += [[part, live, True]] if live else []
    return _point(spark, root, (current(spark, root) or 0) + 1, json.dumps({"parts": parts, "schema": df.schema.jsonValue()}))


def _manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    return json.loads(_pointed(spark, root, number))


def read_buckets(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows, with BUCKET, of a snapshot that ``publish_buckets`` made."""
    manifest = _manifest(spark, root, number)
    schema = StructType.fromJson(manifest["schema"])
    # a part none of whose buckets was replaced is one path
    paths = [p for part, live, whole in manifest["parts"] for p in ([f"{root}/part={part}"] if whole else [f"{root}/part={part}/{BUCKET}={b}" for b in live])]
    if not paths:
        return spark.createDataFrame([], schema)
    whole = StructType([f for f in schema.fields if f.name != BUCKET]).add("part", StringType()).add(BUCKET, IntegerType())
    return spark.read.schema(whole).option("basePath", root).parquet(*paths).select(*schema.fieldNames())


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete parts that none of the last ``keep`` snapshots holds, and older pointers; returns how many parts went."""
    names = _pointers(spark, root)
    needed = {p for n in names[-keep:] for p, *_ in _manifest(spark, root, int(n.split("-")[1]))["parts"]}
    fs, p = _fs(spark, root)
    for n in names[:-keep]:
        fs.delete(_fs(spark, f"{root}/{n}")[1], False)
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part=") and s.getPath().getName()[5:] not in needed]
    for x in gone:
        fs.delete(x, True)
    return len(gone)


def _pointers(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("current-")) if fs.exists(p) else []


def current(spark: SparkSession, root: str) -> int | None:
    names = _pointers(spark, root)
    return int(names[-1].split("-")[1]) if names else None


def _pointed(spark: SparkSession, root: str, number: int | None = None) -> str:
    names = _pointers(spark, root)
    if number is not None:
        names = [n for n in names if int(n.split("-")[1]) == number]
    if not names:
        raise FileNotFoundError(f"no snapshot in {root}")
    fs, p = _fs(spark, f"{root}/{names[-1]}")
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    text = reader.readLine()
    reader.close()
    return text


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of the newest (or the numbered) snapshot."""
    return spark.read.parquet(f"{root}/{_pointed(spark, root, number)}")
