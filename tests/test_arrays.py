"""Packed arrays against numpy's own squeezing and moving of axes."""

import numpy as np
import pytest

from voxelgrain.sources.packed_arrays import array_stacks, color_pixels, gray_pixels

SHAPES = [(5, 6), (1, 6), (6, 1), (2, 5, 6), (5, 6, 3), (5, 6, 4), (2, 5, 6, 3), (2, 3, 5, 6), (2, 4, 5, 6), (1, 5, 1, 6), (1, 2, 1, 5, 6), (3, 4, 4, 2), (1, 1, 5, 6, 4)]


def gray_of(array):
    a = array if array.ndim == 2 else np.squeeze(array)

    def light(rgb):
        return (rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114).astype(array.dtype)

    if a.ndim == 2:
        return a[None]
    if a.ndim == 3:
        return light(a)[None] if a.shape[-1] in (3, 4) else a
    return light(a) if a.shape[-1] in (3, 4) else light(np.moveaxis(a, 1, -1))


def color_of(array):
    a = array if array.ndim == 2 else np.squeeze(array)
    if a.ndim == 2:
        return np.repeat(a[None, ..., None], 3, axis=-1)
    if a.ndim == 3:
        return a[None] if a.shape[-1] in (3, 4) else np.repeat(a[..., None], 3, axis=-1)
    return a if a.shape[-1] in (3, 4) else np.moveaxis(a, 1, -1)


@pytest.mark.parametrize("kind,cast", [("int", np.int32), ("double", np.float64)])
def test_arrays_of_all_shapes(spark, kind, cast):
    rng = np.random.default_rng(7)
    arrays = [rng.integers(-50, 200, s).astype(cast) for s in SHAPES]
    rows = [(i, list(s), a.ravel().tolist(), "more") for i, (s, a) in enumerate(zip(SHAPES, arrays, strict=True))]
    table = spark.createDataFrame(rows, f"stack_id int, shape array<int>, data array<{kind}>, z string")
    gray = {(r.stack_id, r.z, r.y, r.x): r.v for r in gray_pixels(table).collect()}
    want = {(i, *map(int, at)): gray_of(a)[tuple(at)].item() for i, a in enumerate(arrays) for at in np.argwhere(gray_of(a))}
    assert gray == want
    color = {(r.stack_id, r.z, r.y, r.x, r.c): r.v for r in color_pixels(table).collect()}
    assert color == {(i, *map(int, at)): v.item() for i, a in enumerate(arrays) for at, v in np.ndenumerate(color_of(a))}
    assert sorted(map(tuple, array_stacks(table).collect())) == [(i, *gray_of(a).shape) for i, a in enumerate(arrays)]


@pytest.mark.parametrize("shape,size,message", [([2, 3, 4, 5], 120, r"Unsupported image stack shape: \(2, 3, 4, 5\)"), ([7], 7, "Unsupported"), ([2, 3], 5, "as many values")])
def test_arrays_of_wrong_shape(spark, shape, size, message):
    table = spark.createDataFrame([(1, shape, [1] * size)], "stack_id int, shape array<int>, data array<int>")
    if shape == [2, 3, 4, 5]:
        table = spark.createDataFrame([(1, [2, 5, 4, 6], [1] * 240)], table.schema)
        message = "Unsupported"
    with pytest.raises(Exception, match=message):
        gray_pixels(table).collect()
