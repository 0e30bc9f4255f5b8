"""Passages of a benchmark inside reports, found by spaced seeds and verified with substitutions allowed.

The reference's own validation compares numbers, not texts, so the benchmark is a general table (item_id, text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.byte_pairs import LETTER, NUMBER, character_classes
from voxelgrain.llm.records import REPORT, STACK, Shared, text_slices

WINDOW = 15
# masks by the number of words of an item, from that many on: with as many other words as a fifth of the item or of the window
# allows, one of the masks always finds equal words in its places
MASKS = {
    15: ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10)),
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    5: ((0, 1, 2), (0, 1, 4)),
}
# items of fewer words are compared with whole texts
LEAST_WORDS = min(MASKS)
HITS_AT_ONCE = 1 << 20
BLOCK_WORDS = 1 << 20
FILTER_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for every lower-cased word of all texts, and the number of words of each text.

    Words are runs of letters, digits and underscores.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    bounds = np.append(0, np.cumsum(sizes))
    kind = classes[points]
    inside = (kind == LETTER) | (kind == NUMBER) | (points == 95)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(points)]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    first = (np.cumsum(inside) - 1)[starts]
    letters = points[inside].astype(np.uint64)
    lengths = np.diff(np.append(first, len(letters)))
    offset = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), MIX, np.uint64))
    code = np.add.reduceat((letters + np.uint64(1)) * powers[offset], first)
    code ^= code >> np.uint64(31)
    return code * MIX, counts


def seed_codes(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """One code for every place of a mask in a sequence of word codes; words between its places are ignored."""
    span = mask[-1] + 1
    total = np.full(max(len(words) - span + 1, 0), number + 1, np.uint64)
    weights = np.cumprod(np.full(len(mask), MIX | np.uint64(2 * number + 1), np.uint64))
    for place, weight in zip(mask, weights, strict=True):
        total += words[place : place + len(total)] * weight
    return (total ^ (total >> np.uint64(29))) * MIX


class SeedTable:
    """The seeds of one block of benchmark items in sorted arrays, with a bit filter of fixed size before them."""

    def __init__(self, items: list[tuple[object, str | None]], classes: np.ndarray):
        self.classes = classes
        codes, counts = word_codes([t for _, t in items], classes)
        self.ids = [i for i, _ in items]
        self.words = np.split(codes, np.cumsum(counts)[:-1]) if items else []
        seeds, owners, places = [], [], []
        self.masks: list[tuple[int, tuple[int, ...]]] = []
        self.whole: dict[bytes, list[int]] = {}
        bounds = sorted(MASKS) + [None]
        numbered = [(least, mask) for least in bounds[:-1] for mask in MASKS[least]]
        for number, (least, mask) in enumerate(numbered):
            above = bounds[bounds.index(least) + 1]
            used = [n for n, w in enumerate(self.words) if len(w) >= least and (above is None or len(w) < above)]
            if used:
                self.masks.append((number, mask))
            for n in used:
                own = seed_codes(self.words[n], mask, number)
                seeds.append(own)
                owners.append(np.full(len(own), n))
                places.append(np.arange(len(own)))
        for n, w in enumerate(self.words):
            if 0 < len(w) < LEAST_WORDS:
                self.whole.setdefault(w.tobytes(), []).append(n)
        joined = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.seeds = joined[order]
        self.owners = np.concatenate(owners)[order] if seeds else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if seeds else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - FILTER_BITS)] = True

    def overlaps(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, matching words, first word of the text) of every verified overlap, best per item."""
        codes, counts = word_codes(texts, self.classes)
        ends = np.cumsum(counts)
        begins = ends - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        longest = max(map(len, self.words), default=0)
        span = len(codes) + longest + 1
        found = [np.zeros(0, np.int64)]
        for number, mask in self.masks:
            own = seed_codes(codes, mask, number)
            hit = np.flatnonzero(self.filter[own >> np.uint64(64 - FILTER_BITS)])
            hit = hit[owner[hit] == owner[np.minimum(hit + mask[-1], len(owner) - 1)]]
            low = np.searchsorted(self.seeds, own[hit], side="left")
            many = np.searchsorted(self.seeds, own[hit], side="right") - low
            # words that repeat meet in many places on few diagonals, so only the diagonals of a bounded number of hits are held
            turn = np.cumsum(many) // HITS_AT_ONCE
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(turn)) + 1) if len(hit) else ():
                at = np.repeat(hit[part], many[part])
                entry = np.repeat(low[part], many[part]) + np.arange(len(at)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                shift = at - self.places[entry] + longest
                found.append(np.unique((owner[at] * len(self.ids) + self.owners[entry]) * span + shift))
        tried = np.unique(np.concatenate(found))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for pair, shift in zip((tried // span).tolist(), (tried % span - longest).tolist(), strict=True):
            text, item = divmod(pair, len(self.ids))
            words = self.words[item]
            low, high = max(shift, int(begins[text])), min(shift + len(words), int(ends[text]))
            equal = words[low - shift : high - shift] == codes[low:high]
            window = min(WINDOW, len(words))
            sums = np.cumsum(np.append(0, equal))
            within = sums[window:] - sums[:-window] if len(equal) >= window else sums[-1:]
            # at least four fifths of the window
            if 5 * int(within.max()) >= 4 * window:
                score = (int(equal.sum()), -(low - int(begins[text])))
                if score > best.get((text, item), (-1, 0)):
                    best[text, item] = score
        if self.whole:
            for text in np.flatnonzero((counts > 0) & (counts < LEAST_WORDS)).tolist():
                for item in self.whole.get(codes[begins[text] : ends[text]].tobytes(), ()):
                    best[text, item] = (int(counts[text]), 0)
        for (text, item), (count, start) in sorted(best.items()):
            yield text, item, count, -start


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of about BLOCK_WORDS words, the size that is broadcast at once."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    spaces = F.length("t") - F.length(F.translate("t", " \n\t", ""))
    total = rows.agg(F.coalesce(F.sum(spaces + 1), F.lit(0))).first()[0]
    count = 1 + total // BLOCK_WORDS
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number) if count > 1 else rows
        yield [tuple(r) for r in part.toLocalIterator()]


def benchmark_overlaps(
    reports: DataFrame, benchmark: DataFrame, *, key: str = STACK, text: str = REPORT, item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per report and item that overlap: (key, item, matching_words, item_words, first_word).

    An overlap is a window of fifteen aligned words, or of all words of an item of 5 to 14, of which at least 80 % are equal;
    words beyond the report's ends count as different. An item of one to four words overlaps the reports that consist of the same
    words. Null and empty texts overlap nothing; repeated reports and items repeat, and so do null keys; no rows in, no rows out.
    Words that repeat many times and very long texts cost time in proportion to the pairs of equal seeds, in bounded memory. The benchmark is a stated query set: it is compared with all reports in blocks of bounded size.
    Reports stay where they are read; other columns are not read.
    """
    narrow = reports.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    spark, classes = reports.sparkSession, character_classes()
    schema = T.StructType(
        [
            T.StructField(key, reports.schema[key].dataType), T.StructField("item", T.LongType()),
            T.StructField("matching_words", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("first_word", T.LongType()),
        ]
    )
    out = None
    for block in _blocks(benchmark, item, item_text):
        seeds = Shared(spark, SeedTable(block, classes))

        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            table = seeds.value
            for batch in batches:
                for part in text_slices(batch, "_text"):
                    rows = list(table.overlaps(part.column("_text").to_pylist())) if part.num_rows else []
                    keys = part.column("_key").take(pa.array([r[0] for r in rows], pa.int64()))
                    numbers = [[r[1] for r in rows], [r[2] for r in rows], [len(table.words[r[1]]) for r in rows], [r[3] for r in rows]]
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(n, pa.int64()) for n in numbers]], names=schema.names)

        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField(item, benchmark.schema[item].dataType)]))
        one = narrow.mapInArrow(run, schema).join(F.broadcast(ids), "item").select(key, item, "matching_words", "item_words", "first_word")
        out = one if out is None else out.unionByName(one)
    return out


def drop_overlapping(
    reports: DataFrame, benchmark: DataFrame, *, key: str = STACK, text: str = REPORT, item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The reports that overlap no item in the sense of ``benchmark_overlaps``, with all their columns, where they were read.

    Null and empty reports stay, repeated rows and rows with a null key stay or go one by one. Without items all stay. Other
    columns may have any names.
    """
    spark, classes, left = reports.sparkSession, character_classes(), reports
    for block in _blocks(benchmark, item, item_text):
        seeds = Shared(spark, SeedTable(block, classes))

        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            table = seeds.value
            for batch in batches:
                for part in text_slices(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    for found in table.overlaps(part.column(text).to_pylist()) if part.num_rows else ():
                        clean[found[0]] = False
                    yield part.filter(pa.array(clean))

        left = left.mapInArrow(run, reports.schema)
    return left
