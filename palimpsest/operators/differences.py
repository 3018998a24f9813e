"""Differences between two copies of a table.

One shuffle. Rows of both copies that repeat a key are reduced inside the batches they are read in, so a hot key shrinks
before it travels; then rows go to ranges of the key's hash and are sorted there by key. A range's task numbers the keys
in order, the same number for both copies, and keeps for either copy a compressed bitmap of the numbers it has: AND-NOT
gives the missing rows, AND the numbers by which the columns of both copies are aligned and compared, column by column.
JSON columns are parsed only where their texts differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import arrow, jsonval
from palimpsest.functions.bitmap import Bitmap

RANGES = 1 << 16  # of the key's hash; a task takes several
BLOCK_ROWS = 65_536  # rows of a range that are held at once


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(False)
    return unlike | (a.is_null().to_numpy(False) != b.is_null().to_numpy(False))


def _first(rows: pa.RecordBatch) -> np.ndarray:
    """Where a sorted batch begins a new (key, side)."""
    n = rows.num_rows
    out = np.ones(n, bool)
    for c in ("key", "side")[: n and 2]:
        x = rows.column(c)
        now = _differ(x.slice(1), x.slice(0, n - 1))
        out[1:] = now if c == "key" else out[1:] | now
    return out


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one key and side in a batch the greatest by time, then by columns."""
    for batch in batches:
        if batch.num_rows and pc.count_distinct(batch.column("key"), "all").as_py() < batch.num_rows:
            by = [("key", "ascending"), ("side", "ascending")] + [(n, "descending") for n in batch.schema.names[3:] if not pa.types.is_nested(batch.schema.field(n).type)]
            ordered = batch.take(pc.sort_indices(batch, by, null_placement="at_end"))
            batch = ordered.filter(pa.array(_first(ordered)))
        yield batch


def _ranged(left: DataFrame, right: DataFrame, key: str, order: str | None, columns: dict[str, Callable[[DataFrame], Column]]) -> tuple[DataFrame, list[str]]:
    """Rows (key, side, range, at, one column for each of ``columns``) of both copies, in ranges, sorted; and the names."""
    names = [f"c{n}" for n in range(len(columns))]

    def side(df: DataFrame, n: int) -> DataFrame:
        k = F.col(key)
        at = F.col(order) if order else F.lit(0)
        return df.select(k.alias("key"), F.lit(n).alias("side"), F.pmod(F.xxhash64(k), F.lit(RANGES)).cast("int").alias("range"), at.alias("at"), *[c(df).alias(f"c{i}") for i, c in enumerate(columns.values())])

    both = side(left, 0).unionByName(side(right, 1))
    small = both.mapInArrow(_reduce, both.schema)
    newest = [F.col(c).desc_nulls_last() for c in ("at", *names)]
    return small.repartition("range").sortWithinPartitions("range", "key", "side", *newest), names


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of whole keys, current rows only, with each row's number and side. Numbers go on through the task."""
    held: list[pa.RecordBatch] = []
    size = base = 0

    def cut(final: bool):
        nonlocal held, size, base
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if not rows:
            return
        rows = rows[0]
        rows = rows.filter(pa.array(_first(rows)))
        key = rows.column("key")
        begins = np.ones(rows.num_rows, bool)
        begins[1:] = _differ(key.slice(1), key.slice(0, rows.num_rows - 1))
        end = rows.num_rows if final else int(np.flatnonzero(begins)[-1])  # the last key may go on
        held, size = [rows.slice(end)], rows.num_rows - end
        if end:
            numbers = base - 1 + np.cumsum(begins[:end])
            base = int(numbers[-1]) + 1
            yield rows.slice(0, end), numbers, rows.column("side").to_numpy()[:end]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield from cut(False)
    if held:
        yield from cut(True)


def _paths(name: str, a, b) -> Iterator[str]:
    """Paths at which two JSON values differ; no data is an object without members."""
    todo = [(name, {} if a is None else a, {} if b is None else b)]
    while todo:
        at, x, y = todo.pop()
        if not (isinstance(x, dict) and isinstance(y, dict)):
            if not jsonval.equal(x, y):
                yield at
            continue
        for k in x.keys() | y.keys():
            if k in x and k in y:
                todo.append((f"{at}.{k}", x[k], y[k]))
            else:
                yield f"{at}.{k}"


def _presence(numbers: np.ndarray, sides: np.ndarray) -> tuple[Bitmap, Bitmap]:
    return Bitmap.of(numbers[sides == 0]), Bitmap.of(numbers[sides == 1])


def _comparer(scalars: dict[str, str], documents: dict[str, str], only_left: str, only_right: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, numbers, sides in _blocks(batches):
            left, right = _presence(numbers, sides)
            base = int(numbers[0])
            place = np.zeros((2, int(numbers[-1]) - base + 1), np.int64)  # the row of each number on either side
            for s in (0, 1):
                place[s, numbers[sides == s] - base] = np.flatnonzero(sides == s)
            at, found = [], []
            for s, bits, finding in ((0, left.andnot(right), only_left), (1, right.andnot(left), only_right)):
                at += place[s, bits.ordinals() - base].tolist()
                found += [finding] * (len(at) - len(found))
            shared = (left & right).ordinals() - base
            a, b = (rows.take(pa.array(place[s, shared])) for s in (0, 1))
            where = place[0, shared]
            for name, column in scalars.items():
                hit = where[_differ(a.column(column), b.column(column))].tolist()
                at += hit
                found += [name] * len(hit)
            for name, column in documents.items():
                hit = np.flatnonzero(_differ(a.column(column), b.column(column)))
                for n, s, t in zip(where[hit].tolist(), a.column(column).take(hit).to_pylist(), b.column(column).take(hit).to_pylist()):
                    paths = list(_paths(name, jsonval.load_any(s), jsonval.load_any(t)))
                    at += [n] * len(paths)
                    found += paths
            yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(at, pa.int64())), arrow.array(found, pa.string())], ["key", "finding"])

    return run


def compare_copies(left: DataFrame, right: DataFrame, key: str = "id", order: str = "created_at", scalars: dict[str, Callable[[DataFrame], Column]] | None = None, documents: tuple[str, ...] = ("data",), only_left: str = "only_primary", only_right: str = "only_olap") -> DataFrame:
    """(key, finding) for each difference between the current rows of two tables.

    finding is ``only_left``/``only_right`` for keys that one side lacks; else the name of a scalar whose values differ
    (null-safe) or, of a JSON column, its name and the dotted path of the member that differs: objects on both sides are
    entered, arrays compared whole. ``scalars`` maps a name to a function from the DataFrame to the Column to compare.
    No data (null, blank, JSON null) counts as an object without members. A text that is not JSON equals only the same
    text; against anything else it is one case under the column's name. The current row of a key is the one with the
    greatest ``order`` (null is the least), of equal ones the one with the greatest values. Null keys are one key. Empty
    tables: everything on the other side is missing. Repeated rows don't matter. Other columns are not read, whatever
    their names.
    """
    scalars = scalars or {}
    columns = scalars | {d: (lambda df, d=d: F.col(d)) for d in documents}
    rows, names = _ranged(left, right, key, order, columns)
    at = dict(zip(columns, names))
    kind = rows.schema["key"].dataType.simpleString()
    compare = _comparer({n: at[n] for n in scalars}, {n: at[n] for n in documents}, only_left, only_right)
    return rows.select("key", "side", *names).mapInArrow(compare, f"key {kind}, finding string").withColumnRenamed("key", key)


def presence(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(n_left, n_right, n_both, n_only_left, n_only_right): keys by side, counted on the presence bitmaps."""
    def run(batches):
        totals = np.zeros(5, np.int64)
        for _, numbers, sides in _blocks(batches):
            a, b = _presence(numbers, sides)
            totals += [len(a), len(b), len(a & b), len(a.andnot(b)), len(b.andnot(a))]
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in totals.tolist()], names)

    names = ["n_left", "n_right", "n_both", "n_only_left", "n_only_right"]
    rows, _ = _ranged(left, right, key, None, {})
    return rows.select("key", "side").mapInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
