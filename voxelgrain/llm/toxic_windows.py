"""Toxicity of reports by how well two zstandard dictionaries compress their windows. General: no record of the library is labelled so."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.records import REPORT, STACK, Shared, text_slices
from voxelgrain.session import materialize

SAMPLE = 6000
STEM = (4, 12)
LEAST_CONTEXTS = 12
LEAST_ODDS = 5.0
LEAST_EVIDENCE = 30.0
MOST_STEMS = 2048
GROWTH = 0.8
WINDOW_WORDS = 6
WORD_BYTES = 64
ORDINARY_WINDOWS = 60_000
ORDINARY_BYTES = 1 << 16
LEVEL = 9
PUNCTUATION = b".,;:!?\"'()|*&%$#"
STRONGEST = 8


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation around them; a word of more than WORD_BYTES bytes is several."""
    words = (text or "").lower().encode().translate(None, PUNCTUATION).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses short windows against a dictionary; frames carry nothing but the blocks."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False,
        write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


@dataclass
class ToxicModel:
    """Contents of both dictionaries and the calibration of the score."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def measure(self) -> "WindowMeasure":
        return WindowMeasure(compressor(self.ordinary), compressor(self.toxic + self.ordinary))


@dataclass
class WindowMeasure:
    ordinary: zstandard.ZstdCompressor
    toxic: zstandard.ZstdCompressor

    def features(self, text: str | None) -> np.ndarray:
        """Largest saving of any window through the toxic dictionary, the sum of the largest ones, and the mean."""
        one, two = self.ordinary.compress, self.toxic.compress
        saved = np.array([len(one(w)) - len(two(w)) for w in windows(plain_words(text))] or [0], float)
        best = np.sort(saved)[::-1][:STRONGEST]
        return np.array([1.0, best[0], np.maximum(best, 0).sum() / STRONGEST, saved.mean()])


def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))


def calibrate(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic score by Newton steps with a small penalty."""
    weights = np.zeros(features.shape[1])
    penalty = np.eye(len(weights)) * 0.1
    for _ in range(30):
        p = scores(features, weights)
        slope = features.T @ (labels - p) - penalty @ weights
        weights = weights + np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty, slope)
    return weights


def _stems(sample: DataFrame) -> list[bytes]:
    """Word beginnings that toxic texts use in many contexts and ordinary ones hardly, the most frequent last.

    A context is the word before, so that copies of one text do not count as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = plain_words(text)
                found = sorted(set(zip([b"", *words], words, strict=False)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(found), pa.int32()), pa.array([p for p, _ in found], pa.binary()), pa.array([w for _, w in found], pa.binary())],
                    names=["label", "before", "word"],
                )

    pairs = materialize(sample.select("label", "text").mapInArrow(run, "label int, before binary, word binary").distinct())
    totals = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    lengths = F.sequence(F.lit(STEM[0]), F.least(F.length("word"), F.lit(STEM[1])))
    long_enough = pairs.where(F.length("word") >= STEM[0])
    stems = long_enough.select("label", F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("stem"))
    counted = stems.groupBy("stem").agg(
        F.sum(F.col("label").cast("bigint")).alias("toxic"), F.sum((1 - F.col("label")).cast("bigint")).alias("ordinary")
    )
    toxic, ordinary = totals.get(1, 0) + 1, totals.get(0, 0) + 1
    odds = ((F.col("toxic") + 0.5) / toxic) / ((F.col("ordinary") + 0.5) / ordinary)
    both = (F.col("toxic") + F.col("ordinary") + 1) / (toxic + ordinary)
    # likelihood ratio of two rates against one
    evidence = 2 * (
        (F.col("toxic") + 0.5) * F.log((F.col("toxic") + 0.5) / (both * toxic))
        + (F.col("ordinary") + 0.5) * F.log((F.col("ordinary") + 0.5) / (both * ordinary))
    )
    strong = (F.col("toxic") >= LEAST_CONTEXTS) & (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)
    chosen = counted.where(strong).orderBy(F.desc(evidence), "stem").limit(MOST_STEMS)
    held = {bytes(r["stem"]): r["toxic"] for r in chosen.collect()}
    grown = set()
    for stem in (s for s in held if not any(s[:n] in held for n in range(STEM[0], len(s)))):
        while longer := [s for s in held if len(s) == len(stem) + 1 and s.startswith(stem) and held[s] >= GROWTH * held[stem]]:
            stem = max(longer, key=lambda s: (held[s], s))
        grown.add(stem)
    return sorted(grown, key=lambda s: (held[s], s))


def _ordinary(sample: DataFrame, stems: list[bytes]) -> bytes:
    """Content of the ordinary dictionary, trained on windows of ordinary texts without stems, chosen by their hash."""
    marks = [b" " + s for s in stems]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = {w for w in windows(plain_words(text), 2 * WINDOW_WORDS) if not any(m in w for m in marks)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["part"])

    parts = sample.where("label = 0").select("text").mapInArrow(run, "part binary").distinct()
    chosen = [bytes(r[0]) for r in parts.orderBy(F.xxhash64("part"), "part").limit(ORDINARY_WINDOWS).collect()]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, chosen, level=3).as_bytes()
    except zstandard.ZstdError:
        # too few windows to train on: they are the dictionary themselves
        return b"".join(chosen)[-ORDINARY_BYTES:] or b" " * 8


def fit_toxic(
    reports: DataFrame, labels: DataFrame, *, key: str = STACK, text: str = REPORT, label: str = "toxic", sample: int = SAMPLE
) -> ToxicModel:
    """Learns from at most ``sample`` labelled reports of each kind, chosen by a hash of their key.

    Two thirds of them give the dictionaries, one third the calibration. Unlabelled reports and null labels are not used;
    without any toxic report every score is low.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in wanted.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, 2.0 * sample / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, 2.0 * sample / max(1, sizes.get(0, 0)))))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / (1 << 30)
    order = Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id")
    chosen = wanted.where(place <= share).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    # at most 2 * sample rows of (key, label)
    rows = reports.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen.select("_id", "label", "n")), "_id")
    rows = materialize(rows.groupBy("_id", "label", "n").agg(F.max("text").alias("text")))
    learning = rows.where("n % 3 <> 0")
    stems = _stems(learning)
    model = ToxicModel(_ordinary(learning, stems), b"".join(b" " + s for s in stems) + b" ", np.zeros(4))
    measured = _measured(rows.where("n % 3 = 0").select("label", "text"), model, "text", ["label"])
    found = [(list(r["features"]), r["label"]) for r in measured.collect()]
    if not found:
        found = [([1.0, 0.0, 0.0, 0.0], 0)]
    model.weights = calibrate(np.array([f for f, _ in found]), np.array([y for _, y in found], float))
    return model


def _measured(rows: DataFrame, model: ToxicModel, text: str, kept: list[str]) -> DataFrame:
    shared = Shared(rows.sparkSession, model)
    fields = [rows.schema[k] for k in kept] + [T.StructField("features", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = shared.value.measure()
        for batch in batches:
            for part in text_slices(batch, text):
                found = [measure.features(t).tolist() for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(found, pa.list_(pa.float64()))], names=[*kept, "features"])

    return rows.mapInArrow(run, T.StructType(fields))


def score_toxic(reports: DataFrame, model: ToxicModel, *, key: str = STACK, text: str = REPORT) -> DataFrame:
    """(key, score, predicted) of every report: 0 to 1, and 1 from a score of 0.5 on.

    Each window of six words is compressed with the ordinary dictionary and with the toxic one before it; savings of the
    second feed a calibrated score. Null and empty texts save nothing. Repeated rows repeat; other columns are not read.
    """
    rows = reports.select(F.col(key), F.col(text).alias("_text"))
    measured = _measured(rows, model, "_text", [key])
    power = sum((F.col("features")[i] * F.lit(float(w)) for i, w in enumerate(model.weights)), F.lit(0.0))
    score = 1 / (1 + F.exp(-power))
    return measured.select(key, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
