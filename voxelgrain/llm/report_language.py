"""Language of reports by the nearest of several centroids per language. General: no record of the library names a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.byte_pairs import LETTER, character_classes
from voxelgrain.llm.records import REPORT, STACK, Shared, text_slices

BITS = 12
SIZE = 1 << BITS
SAMPLE = 2048
CENTROIDS = 4
ROUNDS = 8
MOST_LANGUAGES = 256
REJECT_SHARE = 0.2
TEXTS_AT_ONCE = 256
UNKNOWN = "und"
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def gram_counts(texts: list[str | None], classes: np.ndarray) -> np.ndarray:
    """Counts of hashed letter n-grams, n from 1 to 3, for each text; everything but letters counts as one kind of gap."""
    lowered = [(t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    letters = np.where(classes[points] == LETTER, points, 0).astype(np.uint64)
    total = np.zeros(len(texts) * SIZE, np.int64)
    mixed, some = np.zeros(len(letters), np.uint64), np.zeros(len(letters), bool)
    for n, factor in enumerate(FACTORS):
        count = len(letters) - n
        if count <= 0:
            break
        mixed = mixed[:count] + (letters[n:] + np.uint64(1)) * np.uint64(factor)
        some = some[:count] | (letters[n:] > 0)
        use = some & (owner[:count] == owner[n:])
        spread = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(FACTORS[0])
        bucket = (spread >> np.uint64(64 - BITS)).astype(np.int64)
        total += np.bincount((owner[:count] * SIZE + bucket)[use], minlength=len(total))
    return total.reshape(len(texts), SIZE)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of unit length, the language of each, gram weights and the similarity below which a text is rejected."""

    languages: list[str]
    owners: np.ndarray
    centroids: np.ndarray
    weights: np.ndarray
    least: float
    classes: np.ndarray

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = gram_counts(texts, self.classes)
        return unit_rows(np.sqrt(counts).astype(np.float32) * self.weights), counts.any(axis=1)

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity and rejection of each text."""
        if not len(self.owners):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows, lettered = self.vectors(texts)
        likeness = rows @ self.centroids.T
        best = likeness.argmax(axis=1)
        score = np.clip(likeness[np.arange(len(texts)), best], 0, 1).astype(float)
        names = [self.languages[self.owners[b]] if some else UNKNOWN for b, some in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0), ~lettered | (score < self.least)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def cluster(rows: np.ndarray, count: int) -> np.ndarray:
    """Unit centroids of unit rows: starts are rows far from each other, then a few rounds of reassignment."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(ROUNDS):
        owner = (rows @ centres.T).argmax(axis=1)
        centres = unit_rows(np.stack([rows[owner == c].sum(axis=0) if (owner == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def _document_frequencies(texts: DataFrame, classes: Broadcast) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed gram occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for part in text_slices(batch, "_text"):
                found = part.column("_text").to_pylist()
                for at in range(0, len(found), TEXTS_AT_ONCE):
                    held += (gram_counts(found[at : at + TEXTS_AT_ONCE], classes.value) > 0).sum(axis=0)
                rows += len(found)
        slots = np.append(np.flatnonzero(held), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.append(held, rows)[slots], pa.int64())], names=["slot", "held"])

    counted = texts.mapInArrow(run, "slot bigint, held bigint").groupBy("slot").agg(F.sum("held").alias("held")).collect()
    total = np.zeros(SIZE + 1, np.int64)
    for slot, held in counted:
        total[slot] = held
    return total[:SIZE], int(total[SIZE])


def fit_languages(labelled: DataFrame, *, key: str = STACK, text: str = REPORT, language: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from rows with a language; gram weights come from all of them, centroids from about ``sample`` rows.

    ``sample`` bounds the rows whose vectors reach the driver: an equal share per language, chosen by a hash of the key.
    Without any row the model knows no language and rejects everything. More than MOST_LANGUAGES languages are an error.
    """
    classes = character_classes()
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    rows = labelled.where(F.col(language).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(language).cast("string").alias("_lang"))
    sizes = dict(tuple(r) for r in rows.groupBy("_lang").count().orderBy("_lang").limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    held, count = _document_frequencies(rows.select("_text"), shared) if sizes else (np.zeros(SIZE, np.int64), 0)
    weights = (np.log((1 + count) / (1 + held)) + 1).astype(np.float32)
    if not sizes:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32), weights, 0.0, classes)
    share = max(8, sample // len(sizes))
    place = F.pmod(F.xxhash64("_key", "_lang"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 3.0 * share / n)))]), F.col("_lang"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_key", "_lang"), F.xxhash64("_text"))
    chosen = rows.withColumn("_place", place).where(F.col("_place") <= wanted)
    chosen = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share).select("_lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                found = part.column("_text").to_pylist()
                for at in range(0, len(found), TEXTS_AT_ONCE):
                    counts = gram_counts(found[at : at + TEXTS_AT_ONCE], shared.value)
                    packed = [unit_rows((np.sqrt(c).astype(np.float32) * weights)[None])[0].astype(np.float16).tobytes() for c in counts]
                    names = part.column("_lang").slice(at, len(packed))
                    yield pa.RecordBatch.from_arrays([names, pa.array(packed, pa.binary())], names=["_lang", "vector"])

    gathered = chosen.mapInArrow(run, "_lang string, vector binary").collect()
    by_language: dict[str, list[bytes]] = {}
    for name, vector in gathered:
        by_language.setdefault(name, []).append(bytes(vector))
    languages, owners, centres, similar = sorted(by_language), [], [], []
    for n, name in enumerate(languages):
        matrix = np.stack([np.frombuffer(v, np.float16) for v in sorted(by_language[name])]).astype(np.float32)
        matrix = matrix[matrix.any(axis=1)]
        if not len(matrix):
            continue
        own = cluster(unit_rows(matrix), CENTROIDS)
        centres.append(own)
        owners += [n] * len(own)
        similar.append((unit_rows(matrix) @ own.T).max(axis=1))
    if not centres:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32), weights, 0.0, classes)
    least = REJECT_SHARE * float(np.concatenate(similar).min())
    return LanguageModel(languages, np.array(owners), np.concatenate(centres), weights, least, classes)


def identify_languages(reports: DataFrame, model: LanguageModel, *, text: str = REPORT) -> DataFrame:
    """Adds (lang_pred, score, rejected) to every report, or replaces columns of these names.

    ``lang_pred`` is the language of the nearest centroid by cosine, ``und`` for null texts and texts without a letter,
    which are rejected with score 0. ``score`` is the similarity, from 0 to 1. ``rejected`` also marks texts farther from
    every centroid than the model allows. Only the text is used, whole and whatever its length; repeated rows repeat. No rows in,
    no rows out. ``drop_unidentified`` leaves all columns alone.
    """
    shared = Shared(reports.sparkSession, model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in reports.schema.fields if f.name not in {a.name for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, text):
                for at in range(0, part.num_rows, TEXTS_AT_ONCE):
                    rows = part.slice(at, TEXTS_AT_ONCE)
                    names, score, rejected = own.nearest(rows.column(text).to_pylist())
                    columns = [rows.column(f.name) for f in kept]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                        names=[*[f.name for f in kept], *[a.name for a in added]],
                    )

    return reports.mapInArrow(run, T.StructType(kept + added))


def drop_unidentified(reports: DataFrame, model: LanguageModel, *, text: str = REPORT) -> DataFrame:
    """The reports that ``identify_languages`` does not reject, with all their columns as they are, whatever their names.

    Null texts and texts without a letter go; rows stay where they are read; no rows in, no rows out.
    """
    shared = Shared(reports.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, text):
                for at in range(0, part.num_rows, TEXTS_AT_ONCE):
                    rows = part.slice(at, TEXTS_AT_ONCE)
                    _, _, rejected = own.nearest(rows.column(text).to_pylist())
                    yield rows.filter(pa.array(~np.asarray(rejected, bool)))

    return reports.mapInArrow(run, reports.schema)
