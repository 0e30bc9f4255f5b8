"""Whole sorted groups as Arrow tables, inside tasks that Spark partitions and sorts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _changes(table: pa.Table, group_cols: Sequence[str]) -> np.ndarray:
    """True at row i when row i starts another group than row i-1 (row 0 is False)."""
    flags = np.zeros(table.num_rows, dtype=bool)
    for name in group_cols:
        column = table.column(name).combine_chunks()
        if table.num_rows > 1:
            differs = pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1))
            flags[1:] |= np.asarray(pc.fill_null(differs, True))
    return flags


def _whole_groups(batches: Iterator[pa.RecordBatch], group_cols: Sequence[str]) -> Iterator[pa.Table]:
    pending: list[pa.Table] = []
    last_key: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        flags = _changes(table, group_cols)
        first_key = tuple(table.column(c)[0].as_py() for c in group_cols)
        if last_key is not None and first_key != last_key:
            flags[0] = True
        last_key = tuple(table.column(c)[-1].as_py() for c in group_cols)
        starts = np.flatnonzero(flags)
        if len(starts) == 0:
            pending.append(table)
            continue
        cut = int(starts[-1])
        done = pending + ([table.slice(0, cut)] if cut else [])
        if done:
            yield pa.concat_tables(done).combine_chunks()
        pending = [table.slice(cut)]
    if pending:
        yield pa.concat_tables(pending).combine_chunks()


def kept_together(df: DataFrame, group_cols: Sequence[str]) -> bool:
    """Does a repartition by these columns hold through a later window or aggregate by more of them?

    Spark normalises fractional keys there, takes the rows for dealt otherwise and shuffles them again by all its columns.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return not any(isinstance(kinds[c], T.FractionalType) for c in group_cols)


def map_sorted_groups(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]],
    new_fields: Sequence[tuple[str, T.DataType]],
    *,
    arranged: bool = False,
) -> DataFrame:
    """Append columns computed by ``fn`` over whole groups, many groups per Arrow batch.

    Spark places each group in one task and sorts it; ``fn`` gets a table of complete groups and
    a group number per row, and returns one array per new column in row order. ``arranged`` says
    the rows were laid together by ``group_cols``, which saves a shuffle unless a key is fractional.
    """
    base = df if arranged and kept_together(df, group_cols) else df.repartition(*group_cols)
    ordered = base.sortWithinPartitions(*group_cols, *order_cols)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, t, True) for n, t in new_fields])
    names = [n for n, _ in new_fields]
    keys = list(group_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys):
            group = np.cumsum(_changes(table, keys)).astype(np.int64)
            added = fn(table, group)
            for name in names:
                table = table.append_column(name, pa.array(added[name]))
            yield from table.to_batches(max_chunksize=20000)

    return ordered.mapInArrow(run, schema)


def expand_sorted_groups(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]],
    schema: T.StructType,
) -> DataFrame:
    """Rows of ``schema`` that ``fn`` makes of whole groups, which already lie together by ``group_cols``.

    ``fn`` gets a table of complete sorted groups and a group number per row, and yields tables of any number of rows.
    """
    keys = list(group_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys):
            group = np.cumsum(_changes(table, keys)).astype(np.int64)
            for made in fn(table, group):
                yield from made.to_batches(max_chunksize=20000)

    return df.sortWithinPartitions(*group_cols, *order_cols).mapInArrow(run, schema)
