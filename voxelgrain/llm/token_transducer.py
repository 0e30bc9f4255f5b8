"""Byte-pair encoding and decoding of reports as Spark operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelgrain.llm.byte_pairs import MergeTables, TextMachine, encode_texts
from voxelgrain.llm.records import REPORT, Shared, text_slices

FEED_IDS = 1 << 14


def _with_fields(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    taken = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in taken] + fields)


def _replaced(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(added.values()), names=names + list(added))


def encode_reports(reports: DataFrame, tokenizer: str, *, text: str = REPORT) -> DataFrame:
    """Adds (n_tokens, token_ids) to every report, or replaces columns of these names.

    ``token_ids`` are little-endian unsigned 32-bit integers in a binary column. ``tokenizer`` is the path of a byte-level
    vocabulary; its special strings inside texts become their ids, and no others are added. A null text counts as empty and
    gives no ids. Rows are encoded one by one, so repeated rows repeat. The text is cut into pre-tokens; a pre-token longer
    than the merge list's lookahead goes through the transducer, which emits a token once enough bytes follow it.
    """
    tables = Shared(reports.sparkSession, MergeTables(tokenizer))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables.value
        for batch in batches:
            for part in text_slices(batch, text):
                ids = list(encode_texts(part.column(text).to_pylist(), own))
                added = {
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "token_ids": pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                }
                yield _replaced(part, added)

    return reports.mapInArrow(run, _with_fields(reports, fields))


def decode_reports(tokens: DataFrame, tokenizer: str, *, token_ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of ``token_ids`` as column ``decoded``, special strings included; null ids give an empty text.

    Ids are fed piece by piece; an unfinished character waits for its next bytes, and what never becomes one is replaced.
    """
    tables = Shared(tokens.sparkSession, MergeTables(tokenizer))
    fields = [T.StructField(decoded, T.StringType())]

    def one(raw: bytes | None, own: MergeTables) -> str:
        machine = TextMachine(own)
        ids = np.frombuffer(raw or b"", "<u4")
        return "".join([machine.feed(ids[i : i + FEED_IDS]) for i in range(0, len(ids), FEED_IDS)]) + machine.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables.value
        for batch in batches:
            for part in text_slices(batch, token_ids):
                yield _replaced(part, {decoded: pa.array([one(x, own) for x in part.column(token_ids).to_pylist()], pa.string())})

    return tokens.mapInArrow(run, _with_fields(tokens, fields))
