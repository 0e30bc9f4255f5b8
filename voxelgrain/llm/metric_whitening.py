"""Whitening of measured vectors: exact scatter from bit planes, centred as integers, then the principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.functions.geometry import FRAME_METRICS
from voxelgrain.llm.records import STACK, Shared

FRAME = "frame_index"
METRICS = "metrics"
COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LIMIT = float(1 << 56)
BLOCK_ENTRIES = 1 << 20
LIMB = 40
LIMBS = 4
OUTPUT = T.StructType([
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
])


def frame_metric_vectors(rows: DataFrame, *, keys: Sequence[str] = (STACK, FRAME), metrics: Sequence[str] = FRAME_METRICS) -> DataFrame:
    """(keys, metrics): the measured columns of frame rows as one vector for each frame."""
    return rows.select(*keys, F.array(*[F.col(m).cast("double") for m in metrics]).alias(METRICS))


def usable(metrics: Column) -> Column:
    """Is a vector present, not empty, and every entry a finite number whose fixed-point form fits a long?"""
    fits = F.forall(metrics, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    return F.coalesce((F.size(metrics) > 0) & fits, F.lit(False))


def fixed_point(entries: np.ndarray) -> np.ndarray:
    """Entries as whole numbers: floor(64 * entry) + 1000000."""
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def plane_products(values: np.ndarray) -> np.ndarray:
    """Exact sums over rows of all products of two columns of a matrix of long values, as whole numbers of any size.

    Every column is shifted to start at zero and cut into bit planes. A plane is packed along the rows, 64 to a word; the
    product of two columns is the sum over their planes of 2^(i+j) times the number of rows with both bits set.
    """
    rows, width = values.shape
    least = values.min(axis=0)
    shifted = (values - least).view(np.uint64)
    bits = [int(m).bit_length() for m in shifted.max(axis=0)]
    owner = np.repeat(np.arange(width), bits)
    power = np.concatenate([np.arange(b) for b in bits]) if sum(bits) else np.zeros(0, np.int64)
    planes = np.zeros((len(owner), -(-rows // 64) * 8), np.uint8)
    for at, (column, bit) in enumerate(zip(owner.tolist(), power.tolist(), strict=True)):
        planes[at, : -(-rows // 8)] = np.packbits(((shifted[:, column] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8))
    words = planes.view(np.uint64)
    both = np.zeros((len(owner), len(owner)), np.int64)
    for at in range(len(owner)):
        both[at, at:] = np.bitwise_count(words[at] & words[at:]).sum(axis=1, dtype=np.int64)
    both = np.triu(both, 1).T + both
    small = 2 * max(bits, default=0) + rows.bit_length() < 63
    weight = np.zeros((width, len(owner)), np.int64 if small else object)
    weight[owner, np.arange(len(owner))] = [1 << p for p in power.tolist()]
    products = (weight @ both.astype(weight.dtype) @ weight.T).astype(object)
    total = (weight @ np.diag(both).astype(weight.dtype)).astype(object)
    low = least.astype(object)
    return products + np.outer(low, total) + np.outer(total, low) + rows * np.outer(low, low)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and fixed-point values of bounded blocks of rows."""
    size = max(64, BLOCK_ENTRIES // width)
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            entries = part.column("_metrics").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part.column("_key"), fixed_point(entries.reshape(part.num_rows, width))


def scatter_sums(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums and sums of products of their fixed-point entries, all exact.

    A task adds its blocks up and hands on one row for each pair of columns, so what is shuffled and what reaches the driver
    depends on the width of the vectors and the number of tasks only. Sums travel in limbs of 40 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for _, values in _blocks(batches, width):
            total[1:, 1:] += plane_products(values)
            # the row and column of ones
            total[0, 0] += len(values)
            total[0, 1:] += (values >> 20).sum(axis=0).astype(object) * (1 << 20) + (values & ((1 << 20) - 1)).sum(axis=0).astype(object)
        if total[0, 0] == 0:
            return
        one, two = np.triu_indices(width + 1)
        rest, limbs = total[one, two], []
        for _ in range(LIMBS - 1):
            limbs.append(rest & ((1 << LIMB) - 1))
            rest = rest >> LIMB
        arrays = [pa.array(a.astype(np.int32)) for a in (one, two)] + [pa.array(a.astype(np.int64)) for a in (*limbs, rest)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    names = [f"l{k}" for k in range(LIMBS)]
    sums = vectors.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} bigint" for n in names))
    sums = sums.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    held = [[0] * (width + 1) for _ in range(width + 1)]
    for row in sums.collect():
        value = sum(row[n] << (LIMB * k) for k, n in enumerate(names))
        held[row["i"]][row["j"]] = held[row["j"]][row["i"]] = value
    return held[0][0], held[0][1:], [line[1:] for line in held[1:]]


class Whitening:
    """Means and principal components of fixed-point vectors."""

    def __init__(self, count: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS):
        width = len(sums)
        self.count, self.sums, self.width = count, sums, width
        covariance = np.array([
            [(count * products[i][j] - sums[i] * sums[j]) / (count * count) for j in range(width)] for i in range(width)
        ])
        values, directions = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(components, width)]
        values, self.directions = np.maximum(values[order], 0.0), directions[:, order]
        trace = float(np.trace(covariance))
        self.explained = [float(v) / trace if trace > 0 else None for v in values]
        self.present = values > width * np.finfo(float).eps * max(values[0], 0.0) if trace > 0 else np.zeros(len(values), bool)
        self.scale = np.where(self.present, np.sqrt(np.where(self.present, values, 1.0)), np.nan)

    def centred(self, values: np.ndarray) -> np.ndarray:
        """count * value - sum, exactly."""
        most = max(abs(int(values.max())), abs(int(values.min())), 1) * self.count + max(map(abs, self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return values.astype(kind) * self.count - np.array(self.sums, kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; none where it does not fit a long."""
        if centred.dtype != object and int(np.abs(centred).max()) ** 2 * self.width >= 1 << 62:
            centred = centred.astype(object)
        sums = (centred * centred).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each divided by its deviation."""
        if centred.dtype == object:
            real = np.array([[v / self.count for v in row] for row in centred.tolist()])
        else:
            real = centred / self.count
        return real @ self.directions / self.scale


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' measured covariance minus the identity, over the components that vary."""
    shared = Shared(vectors.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = 0
        for _, values in _blocks(batches, own.width):
            white = np.column_stack([np.ones(len(values)), own.whitened(own.centred(values))[:, own.present]])
            total = total + white.T @ white
        if np.ndim(total):
            one, two = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(total[one, two])], names=["i", "j", "s"])

    rows = vectors.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = int(model.present.sum())
    if not size:
        return None
    total = np.zeros((size + 1, size + 1))
    for i, j, s in rows:
        total[i, j] = total[j, i] = s
    mean = total[0, 1:] / model.count
    return float(np.abs(total[1:, 1:] / model.count - np.outer(mean, mean) - np.eye(size)).max())


def whiten_metrics(
    vectors: DataFrame, *, keys: Sequence[str] = (STACK, FRAME), metrics: str = METRICS, components: int = COMPONENTS
) -> DataFrame:
    """(keys, component, n, deviation, whitened, explained, identity_error): a row for each vector and principal component.

    Works on the measured vectors of frames, as ``frame_metric_vectors`` makes them, or any other arrays of numbers. Entries
    become whole numbers, floor(64 * entry) + 1000000. ``n`` is the number of vectors, ``deviation`` the exact sum of
    (n * value - sum)^2 over a vector, null where it does not fit a long; ``whitened`` the centred vector's part along the
    component over its standard deviation; ``explained`` the component's share of the variance; ``identity_error`` how far the
    covariance of all whitened vectors is from the identity at most. Components go by falling variance and have one sign for
    all rows.

    Vectors that are null or empty or hold a null, an infinity, NaN or a number of 2^56 or more are left out, and so are those
    whose length is not the most frequent one (the shorter of equally frequent ones counts). Along components without variance,
    as when all vectors are equal, ``whitened`` is null, and where none varies so are ``explained`` and ``identity_error``.
    Repeated rows count and come back as often as they occur; null keys come back too. No rows in, no rows out. Other columns
    are not read. The driver holds tables of the size of the squared length of a vector, and nothing that grows with the rows.
    """
    names = list(keys)
    narrow = vectors.where(usable(F.col(metrics))).select(
        F.struct(*[F.col(f"`{k}`") for k in names]).alias("_key"), F.col(metrics).cast("array<double>").alias("_metrics")
    )
    schema = T.StructType([narrow.schema["_key"], *OUTPUT.fields])
    lengths = narrow.groupBy(F.size("_metrics").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema).select("_key.*", *OUTPUT.names)
    fitted = narrow.where(F.size("_metrics") == lengths["width"])
    model = Whitening(*scatter_sums(fitted, lengths["width"]), components)
    error = _identity_error(fitted, model)
    shared = Shared(vectors.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = len(own.explained)
        for key, values in _blocks(batches, own.width):
            centred = own.centred(values)
            rows = len(values)
            white = own.whitened(centred)
            arrays = [
                key.take(pa.array(np.repeat(np.arange(rows), number))), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * number, own.count, np.int64)), pa.array(own.deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(rows), number))),
                pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(own.explained * rows, pa.float64()), pa.array([error] * (rows * number), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return fitted.mapInArrow(run, schema).select("_key.*", *OUTPUT.names)
