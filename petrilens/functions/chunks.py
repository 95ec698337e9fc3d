"""Rows of whole groups in Arrow tables: many small groups in one table, each group in one piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that a table holds at least, unless the task has fewer.
ROWS = 100_000


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before (the first row: true)."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    parts = [pa.concat_arrays(table[k].chunks) if table[k].num_chunks else pa.array([], table[k].type) for k in keys]
    while parts:
        a = parts.pop()
        if pa.types.is_struct(a.type):
            parts += a.flatten()
            continue
        codes = pc.fill_null(a.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def by_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table], pa.Table | Iterator[pa.Table]], schema: StructType | str, spread: bool = False, ranges: bool = False) -> DataFrame:
    """``work`` on tables of whole groups of ``keys``, sorted by keys and ``order``.  A table holds about ``ROWS`` rows of
    as many groups, so that small groups cost no call each; a group larger than that is a table of its own.
    Work whose result is larger than its table may yield it as several.  With ``spread`` (work that costs far more than reading its rows) partitions are not merged for being small.
    With ``ranges`` partitions are ranges of the keys, so that a table holds groups that follow each other."""

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        told = work(table)
        for t in (told,) if isinstance(told, pa.Table) else told:
            yield from t.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most = 0, ROWS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < most:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(starts(table, keys))[-1])
            if last:
                yield from made(table.slice(0, last))
                table = table.slice(last)
            held, n = table.to_batches(), table.num_rows
            most = max(ROWS, 2 * n)  # the group goes on: looked at again at twice its rows
        if n:
            yield from made(pa.Table.from_batches(held))

    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    dealt = df.repartitionByRange(*parts, *keys) if ranges else df.repartition(*parts, *keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
