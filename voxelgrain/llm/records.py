"""Text records the operators of this folder work on: one report per stack."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STACK, REPORT = "stack_id", "report"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_CHARS = 1 << 20


class Shared:
    """An object whose plain attributes are broadcast; its class travels with the task, so workers need no copy of it."""

    def __init__(self, spark: SparkSession, thing: object):
        self.kind = type(thing)
        self.held = spark.sparkContext.broadcast(dict(vars(thing)))

    @property
    def value(self):
        thing = object.__new__(self.kind)
        vars(thing).update(self.held.value)
        return thing


def run_reports(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, report): the lines of ``operators.report.report_lines`` as one text per run.

    A run without lines has no row. One report is bounded by its sections and first rows.
    """
    keys = keys or [STACK]
    ordered = F.array_sort(F.collect_list(F.struct("section", "line_no", "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(REPORT))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold about ``limit`` bytes together; a longer text is alone in its slice."""
    sizes = batch.column(column).nbytes if batch.num_rows else 0
    if sizes <= limit:
        yield batch
        return
    begin, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        own = len(text.as_buffer()) if text.is_valid else 0
        if size and size + own > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += own
    yield batch.slice(begin)
