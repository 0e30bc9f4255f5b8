"""Registered queries against their checking SQL on the smallest tables.

A handful runs by default; CATALOG_ALL=1 runs every query.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
QUICK = (
    "mask_counts", "region_zeroed_low_threshold", "threshold_percentile_embeddings", "slice_contrast_stretch", "components_four",
    "components_across_bands", "enclosed_holes", "outline_measures", "polygon_metrics", "slice_overlap", "surface_of_mask_closed",
    "stack_downsampling", "xml_calibration", "settings_precedence", "compare_numeric", "manifest_index", "distance_map",
    "probe_nearest_edges", "short_numbers",
)
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()
CHOSEN = sorted(ORACLES) if os.environ.get("CATALOG_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        return "nan" if math.isnan(float(v)) else float(v) + 0.0

    return sorted(columns), sorted((tuple(cell(row[i]) for i in order) for row in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
