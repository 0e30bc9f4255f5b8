"""Periodic runs against all periods, whitening against plain matrices, and their queries on the smallest tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from voxelgrain.llm import metric_whitening, periodic_runs
from voxelgrain.llm.queries import QUERIES
from voxelgrain.llm.records import run_reports
from voxelgrain.operators.report import report_lines
from voxelgrain.plans.analyze import Settings, analyze

from tests.conftest import sphere

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "stack_id long, report string, runs string, n_words double, _key string, _text string"


def all_runs(words, least=6, power=4):
    out = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, power * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_all_periods(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(500):
        words = [rng.choice("abcdé"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 50))]
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        place = rng.randint(0, len(words))
        words[place:place] = (unit * 8)[: rng.randint(0, 8 * len(unit))]
        texts.append(rng.choice(["", " ", "\n\x0b"]) + rng.choice([" ", " \t"]).join(words) + rng.choice(["", " "]))
    texts += [None, "", " \n ", "ok " * 30000, " ".join(str(i % 4999) for i in range(25000)), "x\x1cx\x1cx\x1cx\x1cx\x1cx", "a a a a a a a"]
    rows = spark.createDataFrame([(i, t, "r", 1.0, "k", "t") for i, t in enumerate(texts)], SCHEMA)
    for row in periodic_runs.periodic_runs(rows).collect():
        words = WORDS.findall(texts[row["stack_id"]] or "")
        if len(words) < 1000:
            want = all_runs(words)
        else:
            want = [(0, len(words), 1 if words[0] == words[1] else 4999)]
        assert [tuple(r) for r in row["runs"]] == want and row["n_words"] == len(words)
        assert row["collapsed"] == without_repeats(words, want)
    assert periodic_runs.periodic_runs(rows.where("false")).count() == 0


def test_runs_of_other_limits(spark):
    rows = spark.createDataFrame([(None, "a b a b a c c"), (None, "a b a b a c c")], "stack_id long, report string")
    for row in periodic_runs.periodic_runs(rows, least=2, power=2).collect():
        assert [tuple(r) for r in row["runs"]] == [(0, 5, 2), (5, 2, 1)] and row["collapsed"] == "a b c"


def test_place_sets_like_lists():
    rng = random.Random(22)
    values = rng.sample(range(10**6), 6000)
    places = periodic_runs.Places(sorted(values[:2000]))
    held = sorted(values[:2000])
    for value in values[2000:]:
        before, after = places.insert(value)
        at = periodic_runs.bisect(held, value)
        assert (before, after) == (held[at - 1] if at else None, held[at] if at < len(held) else None)
        held.insert(at, value)
    assert list(places) == held and len(places) == 6000


@pytest.fixture(scope="module")
def measured(spark):
    from tests.conftest import Maker

    stacks, pixels = Maker(spark)({"ball": sphere(), "small": sphere(radius=4)})
    return analyze(stacks, pixels, Settings(100.0, only_positive=True))


def test_runs_of_reports_of_the_engine(measured):
    texts = run_reports(report_lines(measured.summary, measured.rows, ["stack_id"]))
    for row in texts.join(periodic_runs.periodic_runs(texts), "stack_id").collect():
        want = all_runs(WORDS.findall(row["report"]))
        assert [tuple(r) for r in row["runs"]] == want


def plain_whitening(vectors, components=32):
    x = np.floor(64 * np.asarray(vectors, float)) + 1000000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in whole]
    return centred @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


def check_whitening(rows, keys, vectors, components):
    white, explained, deviation = plain_whitening(vectors, components)
    place = {k: i for i, k in enumerate(keys)}
    assert len(rows) == len(keys) * len(explained)
    got = np.full(white.shape, np.nan)
    for r in rows:
        i, c = place[r[0]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == len(keys) and r["deviation"] == deviation[i]
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-9) and r["identity_error"] < 1e-6
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * sign, atol=1e-6)


def test_plane_products_are_exact():
    rng = np.random.default_rng(3)
    for low, high, rows in ((-5, 5, 3), (999_000, 1_001_000, 130), (-(1 << 61), 1 << 61, 70), (7, 8, 64)):
        values = rng.integers(low, high, (rows, 4))
        whole = values.astype(object)
        assert (metric_whitening.plane_products(values) == whole.T @ whole).all()


def test_whitening_against_plain_matrices(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3).tolist()
    bad = [None, [], [1.0] * 5, [1.0] * 5 + [None], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1e300] + [0.0] * 5]
    rows = [(i, v, 1, "x", 0.5) for i, v in enumerate(vectors + bad)]
    data = spark.createDataFrame(rows, "stack_id long, metrics array<double>, n int, component string, whitened double").repartition(5)
    check_whitening(metric_whitening.whiten_metrics(data, keys=["stack_id"]).collect(), range(300), vectors, 32)
    check_whitening(metric_whitening.whiten_metrics(data, keys=["stack_id"], components=2).collect(), range(300), vectors, 2)
    nothing = metric_whitening.whiten_metrics(data.where("stack_id >= 300 and stack_id <> 302"), keys=["stack_id"])
    assert nothing.count() == 0 and nothing.columns[:2] == ["stack_id", "component"]


def test_whitening_without_variance(spark):
    data = spark.createDataFrame([(None, [2.0, 3.0])] * 4, "stack_id long, metrics array<float>")
    rows = metric_whitening.whiten_metrics(data, keys=["stack_id"]).collect()
    assert len(rows) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in rows)
    data = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)] * 2, "stack_id long, metrics array<double>")
    rows = metric_whitening.whiten_metrics(data, keys=["stack_id"]).collect()
    assert len(rows) == 16 and all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in rows)


def test_deviation_beyond_a_long(spark):
    data = spark.createDataFrame([(i, [(-1.0) ** i * 2.0**50, float(i)]) for i in range(6)], "stack_id long, metrics array<double>")
    rows = metric_whitening.whiten_metrics(data, keys=["stack_id"]).collect()
    assert len(rows) == 12 and all(r["deviation"] is None for r in rows)
    assert all(math.isclose(abs(r["whitened"]), 1.0, rel_tol=1e-9) for r in rows if r["component"] == 1)


def test_whitening_of_frame_rows(measured):
    vectors = metric_whitening.frame_metric_vectors(measured.rows.where("has_contour"))
    rows = metric_whitening.whiten_metrics(vectors).collect()
    frames = vectors.count()
    assert frames > 10 and {r["n"] for r in rows} == {frames} and {r["component"] for r in rows} == set(range(1, 1 + len(vectors.first()["metrics"])))
    first = [r["whitened"] for r in rows if r["component"] == 1]
    assert math.isclose(sum(v * v for v in first) / frames, 1.0, rel_tol=1e-6)


def test_query_of_runs(spark):
    texts = dict(zip(*(pq.read_table(f"{FOLDER}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    rows = QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        words = WORDS.findall(texts[row["doc_id"]] or "")
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == want
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(without_repeats(words, runs).encode()).hexdigest()


def test_query_of_whitening(spark):
    given = pq.read_table(f"{FOLDER}/embeddings.parquet")
    rows = QUERIES["op13_metric_whitening"](spark, FOLDER).collect()
    check_whitening(rows, given["vec_id"].to_pylist(), given["embedding"].to_pylist(), 32)
