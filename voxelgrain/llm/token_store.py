"""Token ids of reports as directly addressable codes: files from which any single id can be read without decoding a block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.byte_pairs import MergeTables, encode_texts, printable_bytes
from voxelgrain.llm.records import REPORT, STACK, Shared, text_slices

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
END_ID = 0
MEMO_WORDS = 300_000
POSITION_BLOCK = 1 << 18


def pack_ids(ids: np.ndarray) -> bytes:
    """Codes of a sequence of ids.

    Level by level: how many chunks, the chunks of eight bits, one bit per chunk that says whether the next level goes on,
    and for every 512 of these bits how many were set before them.
    """
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > (1 << CHUNK_BITS) - 1
        bits = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.append(0, np.cumsum(sums)[:-1]).astype("<u4") if len(sums) else sums
        levels.append((len(rest), (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) + c + b + r for n, c, b, r in levels)


class PackedIds:
    """Reads codes made by ``pack_ids``; nothing is copied before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        (count,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(count):
            (n,), at = struct.unpack_from("<Q", data, at), at + 8
            bits, ranks = (n + 7) // 8, 4 * ((n + RANK_BITS - 1) // RANK_BITS)
            self.levels.append(
                (np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, bits, at + n), np.frombuffer(data, "<u4", ranks // 4, at + n + bits))
            )
            at += n + bits + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, place: int) -> int:
        """One id: at each level a chunk, a bit and the number of set bits before it."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << (CHUNK_BITS * level)
            if not bits[place >> 3] >> (place & 7) & 1:
                return value
            block = place // RANK_BITS
            before = bits[block * (RANK_BITS // 8) : place >> 3]
            place = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[place >> 3] & ((1 << (place & 7)) - 1)).bit_count()
        raise ValueError("codes end too early")

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids of any places, each by the same few look-ups whatever the length of the segment."""
        value, open_, places = np.zeros(len(places), np.uint32), np.arange(len(places)), places.astype(np.int64)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value[open_] |= chunks[places].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            goes_on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            open_, places = open_[goes_on], places[goes_on]
            if not len(open_):
                return value
            block = places // RANK_BITS
            step = np.arange(RANK_BITS // 8)
            byte = block[:, None] * (RANK_BITS // 8) + step
            whole = np.where(byte < (places >> 3)[:, None], bits[np.minimum(byte, len(bits) - 1)], 0)
            rest = bits[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8)
            places = ranks[block].astype(np.int64) + np.bitwise_count(whole).sum(axis=1, dtype=np.int64) + np.bitwise_count(rest)
        raise ValueError("codes end too early")

    def all(self) -> np.ndarray:
        """All ids at once."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            upper, value = value, chunks.astype(np.uint32)
            value[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))] |= upper << np.uint32(CHUNK_BITS)
        return value


def _library_encoder(tables: MergeTables):
    """Encodes different pre-tokens with the tokenizers library; each worker remembers the first MEMO_WORDS it met."""
    from tokenizers import Tokenizer

    cache = tables.cache
    if "tokenizer" not in cache:
        cache["tokenizer"] = Tokenizer.from_str(tables.described).model
        cache["memo"] = {}
        cache["shown"] = {b: c for c, b in printable_bytes().items()}
    library, memo, shown = cache["tokenizer"], cache["memo"], cache["shown"]

    def encode(words: list[bytes]) -> list[list[int]]:
        # pre-tokens are cut already, so the library's model takes them without its per-text overhead
        coded = {w: [t.id for t in library.tokenize(w.decode("latin-1").translate(shown))] for w in words if w not in memo}
        out = [memo.get(w) or coded[w] for w in words]
        if len(memo) < MEMO_WORDS:
            memo.update(coded)
        return out

    return encode


def write_token_store(reports: DataFrame, tokenizer: str, folder: str, *, key: str = STACK, text: str = REPORT) -> None:
    """Writes the ids of every text and an end id of 0 into ``folder``, in ascending order of the key.

    The rows of the written table are segments: the file part and place they have in the order, the keys and lengths of
    their reports and the codes of the ids. Null and empty texts have the end id alone; a null key comes first; rows that
    share a key are ordered by a hash of their text. Other columns are not read. A segment is as large as one slice of
    texts, so a very long text has a segment of its own.
    """
    tables = MergeTables(tokenizer)
    with open(tokenizer, encoding="utf-8") as handle:
        tables.described = handle.read()
    tables.cache = {}
    shared = Shared(reports.sparkSession, tables)
    narrow = reports.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = narrow.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    key_type = reports.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("n_ids", T.LongType()), T.StructField("codes", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, part_no = shared.value, 0, TaskContext.get().partitionId()
        encode = _library_encoder(own)
        end = np.array([END_ID], np.int32)
        for batch in batches:
            for part in text_slices(batch, "text"):
                if not part.num_rows:
                    continue
                coded = [np.append(ids, end) for ids in encode_texts(part.column("text").to_pylist(), own, encode)]
                lengths = [len(c) for c in coded]
                keys = part.column("key")
                listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part_no], pa.int32()), pa.array([place], pa.int32()), listed, pa.array([lengths], pa.list_(pa.int64())),
                        pa.array([sum(lengths)], pa.int64()), pa.array([pack_ids(np.concatenate(coded))], pa.binary()),
                    ],
                    names=schema.names,
                )
                place += 1

    ordered.mapInArrow(run, schema).write.mode("error").parquet(folder)


def read_token_store(spark: SparkSession, folder: str, *, key: str = STACK) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every report in a folder of segments.

    ``start`` counts the ids of all reports before it, ``n_tokens`` includes the end id, the checksum covers the report's
    ids as little-endian unsigned 32-bit integers.
    """
    segments = spark.read.parquet(folder)
    key_type = segments.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField(key, key_type),
            T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = PackedIds(row.column("codes")[0].as_py()).all().astype("<u4")
                keys = row.column("keys").flatten()
                ends = np.cumsum(row.column("lengths").flatten().to_numpy())
                starts = np.append(0, ends[:-1]).astype(np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                same = [pa.array(np.full(len(keys), row.column(c)[0].as_py(), np.int32)) for c in ("part", "place")]
                yield pa.RecordBatch.from_arrays(
                    [*same, keys, pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=schema.names
                )

    texts = segments.select("part", "place", "keys", "lengths", "codes").mapInArrow(run, schema)
    placed = texts.join(_offsets(segments).select("part", "place", "offset"), ["part", "place"])
    return placed.select(key, (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _offsets(segments: DataFrame) -> DataFrame:
    """(part, place, offset, n_ids): how many ids all segments before one hold."""
    sizes = segments.select("part", "place", "n_ids")
    # one row per file part: their number is the number of partitions, not of reports
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("inner", within).join(parts.select("part", before.alias("outer")), "part")
    return offsets.select("part", "place", (F.col("inner") + F.col("outer")).alias("offset"), "n_ids")


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame, *, position: str = "position") -> DataFrame:
    """(position, token_id) of every different position that the folder holds, counted over all ids of the store from 0.

    Positions meet the segments that hold them by blocks of POSITION_BLOCK ids. A segment is read where some of its positions are
    asked for, and each id by rank look-ups in its codes; nothing else is decoded. Null and outside positions have no row.
    """
    segments = spark.read.parquet(folder)
    asked = positions.select(F.col(position).cast("bigint").alias("p")).where("p is not null").distinct()
    block = f"{{0}} div {POSITION_BLOCK}L"
    held = _offsets(segments).withColumn("block", F.explode(F.expr(f"sequence({block.format('offset')}, {block.format('(offset + n_ids - 1)')})")))
    found = asked.withColumn("block", F.expr(block.format("p"))).join(held, "block").where("p >= offset and p < offset + n_ids")
    # different positions of one segment are no more than its ids
    wanted = found.groupBy("part", "place", "offset").agg(F.collect_list(F.expr("p - offset")).alias("places"))
    schema = T.StructType([T.StructField(position, T.LongType()), T.StructField("token_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, places, codes in zip(*(batch.column(c) for c in ("offset", "places", "codes")), strict=True):
                inside = places.values.to_numpy()
                ids = PackedIds(codes.as_py()).at(inside).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(inside + offset.as_py()), pa.array(ids)], names=schema.names)

    return segments.select("part", "place", "codes").join(wanted, ["part", "place"]).select("offset", "places", "codes").mapInArrow(run, schema)
