"""Conversations formatted as prefix trees: turns that several conversations begin with are emitted once.

General: the library keeps no conversations. A table of turns has (conv_id, turn, role, text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.session import materialize

# fixed values: the control strings of the template
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED = "assistant"
_HIDE = re.compile(r"<(\\*)\|")
_SHOW = re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """Text in which no control string can begin: each ``<|``, with backslashes between or not, gets one more backslash."""
    return _HIDE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def turn_piece(role: str | None, text: str | None) -> str:
    return f"{TURN}{escaped(role or '')}{SAYS}{escaped(text or '')}{END}"


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = piece.removeprefix(TURN).removesuffix(END).partition(SAYS)
    return unescaped(role), unescaped(text)


def _sorted_turns(turns: DataFrame) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    return turns.select(*names).repartition("conv_id").sortWithinPartitions(*names)


@dataclass(frozen=True)
class PackedConversations:
    """The packed sequence as tables.

    ``nodes``: one row per different turn in its tree: (node, parent, owner, depth, start, position, size, learned, piece).
    ``start`` is its place in the packed sequence, which lists every tree depth first; ``position`` is the position id of
    its first character, counted along its own conversation; ``size`` is in code points; ``learned`` says that the text of
    the turn is under the loss mask. ``paths``: (conv_id, depth, node) for every turn. ``attention``: (conv_id, intervals):
    the stretches of the packed sequence that the turns of a conversation may see, as ordered (begin, end).
    """

    nodes: DataFrame
    paths: DataFrame
    attention: DataFrame


def pack_conversations(turns: DataFrame) -> PackedConversations:
    """Merges conversations that share initial turns into trees and lays them out depth first.

    Turns are ordered by (turn, role, text) within a conversation; null roles and texts count as empty, a null conversation
    id is one conversation, repeated rows are turns of their own. An empty table gives empty tables. Other columns are not
    read. The conversation with the smallest id owns a shared turn; equal conversations own nothing beyond the first.
    A task streams the turns of a conversation and holds one at a time.
    """
    key_type = turns.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", key_type), T.StructField("depth", T.LongType()), T.StructField("node", T.BinaryType()),
            T.StructField("parent", T.BinaryType()), T.StructField("position", T.LongType()), T.StructField("size", T.LongType()),
            T.StructField("learned", T.BooleanType()), T.StructField("piece", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, None, 0)
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state = conv, (0, None, 0)
                depth, parent, position = state
                piece = turn_piece(role, text)
                node = hashlib.blake2b((parent or b"") + piece.encode(), digest_size=16).digest()
                rows.append((conv, depth, node, parent, position, len(piece), role == LEARNED, piece))
                state = (depth + 1, node, position + len(piece))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    chain = materialize(_sorted_turns(turns).mapInArrow(run, schema))
    owners = chain.groupBy("node").agg(F.min("conv_id").alias("owner"))
    owned = materialize(chain.select("conv_id", "depth", "node", "position", "size").join(owners, "node"))
    # along a conversation owners only grow; each change is a place where it leaves another conversation's turns
    changes = owned.groupBy("conv_id", "owner").agg(F.min("depth").alias("depth"), F.min("position").alias("position"))
    order = F.array_sort(F.collect_list(F.struct("depth", "owner", "position")))
    routes = changes.groupBy("conv_id").agg(order.alias("route"))
    own = owned.where(F.col("conv_id").eqNullSafe(F.col("owner"))).groupBy("conv_id").agg(F.sum("size").alias("own_size"))
    # the first turns of an owner come before what leaves it, and what leaves it later before what leaves it earlier
    key = F.transform("route", lambda r: F.struct((-r["depth"]).alias("d"), r["owner"].alias("o")))
    placed = _depth_first(routes.join(own, routes["conv_id"].eqNullSafe(own["conv_id"]), "left").select(routes["conv_id"], "route", key.alias("key"), F.coalesce("own_size", F.lit(0)).alias("own_size")))
    starts = placed.select(F.col("conv_id").alias("owner"), "start", (F.element_at("route", -1)["position"]).alias("begins"), "own_size").where("own_size > 0")
    starts = materialize(starts.drop("own_size"))
    first = chain.join(owners, "node").where(F.col("conv_id").eqNullSafe(F.col("owner")))
    nodes = first.join(starts.withColumnRenamed("owner", "_o"), F.col("owner").eqNullSafe(F.col("_o"))).select(
        "node", "parent", "owner", "depth", (F.col("start") + F.col("position") - F.col("begins")).alias("start"), "position", "size", "learned", "piece"
    )
    sizes = chain.groupBy("conv_id").agg(F.sum("size").alias("total"))
    routed = routes.join(sizes, routes["conv_id"].eqNullSafe(sizes["conv_id"])).select(routes["conv_id"], "route", "total")
    stops = F.transform("route", lambda r, i: F.struct(r["owner"].alias("owner"), r["position"].alias("a"), F.coalesce(F.get("route", i + 1)["position"], F.col("total")).alias("b")))
    spread = routed.select("conv_id", F.explode(stops).alias("s")).select("conv_id", "s.*")
    seen = spread.join(starts.withColumnRenamed("owner", "_o"), F.col("owner").eqNullSafe(F.col("_o"))).select(
        "conv_id", "a", F.struct((F.col("start") + F.col("a") - F.col("begins")).alias("begin"), (F.col("start") + F.col("b") - F.col("begins")).alias("end")).alias("i")
    )
    attention = seen.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "i"))), lambda x: x["i"]).alias("intervals"))
    return PackedConversations(nodes, chain.select("conv_id", "depth", "node"), attention)


def _depth_first(routes: DataFrame) -> DataFrame:
    """Adds ``start``: the sizes of all conversations before this one in depth-first order."""
    numbered = routes.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = T.StructType(list(numbered.schema.fields) + [T.StructField("part", T.IntegerType()), T.StructField("inner", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            inner = []
            for size in batch.column("own_size").to_pylist():
                inner.append(total)
                total += size
            added = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(inner, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "inner"])

    written = materialize(numbered.mapInArrow(run, schema))
    # one row per partition
    parts = written.groupBy("part").agg(F.sum("own_size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.join(parts.select("part", before.alias("outer")), "part").withColumn("start", F.col("outer") + F.col("inner"))


def read_conversations(packed: PackedConversations) -> DataFrame:
    """(conv_id, depth, role, text, learned, size): every conversation's turns again, read from the packed sequence."""
    pieces = packed.paths.join(packed.nodes.select("node", "piece", "learned", "size"), "node").drop("node")
    full = T.StructType(list(pieces.schema.fields) + [T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_piece(p) for p in batch.column("piece").to_pylist()]
            added = [pa.array([r for r, _ in read], pa.string()), pa.array([t for _, t in read], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "role", "text"])

    return pieces.mapInArrow(run, full).select("conv_id", "depth", "role", "text", "learned", "size")


def conversation_digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) by streaming sorted turns."""
    key_type = read.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", key_type), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = object()
        done: list[list] = []
        kind = None

        def close() -> None:
            if held:
                turns, loss, numbers = held
                done.append([last, numbers[0], turns.hexdigest(), numbers[1], loss.hexdigest(), numbers[2]])

        def flush() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*done, strict=True)) if done else [[]] * len(types)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "size"))
            for conv, role, text, learned, size in zip(*columns, strict=True):
                if not held or conv != last:
                    close()
                    last, held = conv, [hashlib.sha256(), hashlib.sha256(), [0, 0, 0]]
                held[0].update(f"{role}\n{text}\n".encode())
                held[2][0] += 1
                held[2][2] += size
                if learned:
                    held[1].update(text.encode())
                    held[2][1] += len(text)
            yield flush()
        close()
        if kind is not None:
            yield flush()

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, schema)
