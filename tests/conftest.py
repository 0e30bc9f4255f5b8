import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelgrain.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[*]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


class Maker:
    """Small stacks from arrays; zeros are left out."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, arrays, voxel=(1.0, 1.0, 1.0), source="override"):
        pixels, stacks = [], []
        for name, a in arrays.items():
            a = np.asarray(a, dtype=float)
            z, y, x = np.nonzero(a)
            pixels.append(pd.DataFrame({"stack_id": name, "z": z, "y": y, "x": x, "v": a[z, y, x]}))
            stacks.append((name, f"{name}.tif", *a.shape, *voxel, source))
        p = self.spark.createDataFrame(pd.concat(pixels), "stack_id string, z int, y int, x int, v double")
        s = self.spark.createDataFrame(
            stacks,
            "stack_id string, source_path string, nz int, ny int, nx int, vx_um double, vy_um double, vz_um double, voxel_source string",
        )
        return s, p


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)


def sphere(shape=(10, 40, 40), centre=(5, 20, 20), radius=6, value=255):
    z, y, x = np.indices(shape)
    cz, cy, cx = centre
    return np.where(np.sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) < radius, value, 0)


def touching(value=220):
    _, y, x = np.indices((5, 80, 80))
    return np.where((np.hypot(x - 30, y - 40) < 12) | (np.hypot(x - 48, y - 40) < 8), value, 0)


def seed(name, x, y, frame, radius=10.0, reach=None, seed_id="s", points=None):
    return (name, seed_id, float(x), float(y), frame, float(radius), reach, "polygon" if points else "circle", points)
