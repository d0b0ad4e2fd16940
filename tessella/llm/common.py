"""What the operators of this subpackage share: written tables and streamed groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.store import new_path, quoted, written

__all__ = ["binary", "free_names", "join_hot", "new_path", "partitions", "quoted", "streamed_groups", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of `df` has, in any case."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"__{i}" not in taken:
            out.append(f"__{i}")
        i += 1
    return out


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, copies: str, share: int = 1000) -> DataFrame:
    """rows joined with keyed on `key`, of which `keyed` has one row per value, with its number of rows in `copies` (dropped).

    Values that hold a `share`-th of all rows or more, of which there are no more than `share`, are broadcast
    to the rows, which stay where they are; only the other rows are shuffled. Both tables are read twice.
    """
    least = max(2, -(-(keyed.agg(F.sum(copies)).first()[0] or 0) // share))
    hot = F.broadcast(keyed.where(F.col(copies) >= least).drop(copies))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(copies) < least).drop(copies), key)
    return rows.join(hot, key).unionByName(rest)


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Splits rows sorted by their first `keys` integer columns into one table per key.

    Holds one group and one batch at a time, so memory follows the largest group, not the partition.
    """
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.zeros(n, bool)
        changed[0] = True
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changed).tolist()
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if current is not None:
        yield current, pa.Table.from_batches(held)
