"""Periodic runs of words: suffix classes united by falling common length, repetitions read off newly adjacent places."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.records import REPORT, STACK, text_slices

LEAST = 6
POWER = 4
BLOCK = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Places:
    """An ordered set of word places in blocks of bounded length, so that a large set takes new members cheaply."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, ordered: list[int]):
        self.blocks = [ordered[i : i + BLOCK] for i in range(0, len(ordered), BLOCK)]
        self.firsts = [b[0] for b in self.blocks]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, place: int) -> tuple[int | None, int | None]:
        """Take a place in; the members next to it before and after."""
        at = max(bisect(self.firsts, place) - 1, 0)
        block = self.blocks[at]
        spot = bisect(block, place)
        before = block[spot - 1] if spot else (self.blocks[at - 1][-1] if at else None)
        after = block[spot] if spot < len(block) else (self.firsts[at + 1] if at + 1 < len(self.blocks) else None)
        block.insert(spot, place)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(at + 1, block[BLOCK])
        return before, after


def repetitions(first: list[int], second: list[int], common: list[int], least: int, power: int) -> dict[tuple[int, int], int]:
    """{(period, end): start} of the runs, from suffixes that neighbour in order and how many words each pair shares.

    The pairs come by falling ``common``. Each unites the classes of its two suffixes, the smaller into the larger. Places of
    different classes that become neighbours share exactly ``common`` words; at a distance of no more than that they are a
    period apart. A run's first place and the one a period later always meet so, nothing between them shares as many words.
    """
    parent: dict[int, int] = {}
    members: dict[int, list[int] | Places] = {}
    found: dict[tuple[int, int], int] = {}

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if shared >= (power - 1) * period and shared >= least - period:
            key = (period, j + shared)
            if found.get(key, i) >= i:
                found[key] = i

    def root(i: int) -> int:
        while True:
            up = parent.get(i, i)
            if up == i:
                return i
            over = parent.get(up, up)
            parent[i] = over
            i = over

    for a, b, shared in zip(first, second, common, strict=True):
        a, b = root(a), root(b)
        large, small = members.get(a), members.get(b)
        if large is None and small is None:
            parent[b] = a
            members[a] = [a, b] if a < b else [b, a]
            seed(min(a, b), max(a, b), shared)
            continue
        if large is None or (small is not None and len(small) > len(large)):
            a, b, large, small = b, a, small, large
        parent[b] = a
        coming = [b] if small is None else list(small)
        members.pop(b, None)
        if not isinstance(large, Places) and len(large) > BLOCK:
            large = members[a] = Places(large)
        last = None
        for at, place in enumerate(coming):
            if isinstance(large, Places):
                before, after = large.insert(place)
            else:
                spot = bisect(large, place)
                before = large[spot - 1] if spot else None
                after = large[spot] if spot < len(large) else None
                large.insert(spot, place)
            if before is not None and before != last:
                seed(before, place, shared)
            # a later member of the same class may still come in between
            if after is not None and (at + 1 == len(coming) or coming[at + 1] > after):
                seed(place, after, shared)
            last = place
    return found


def _ranks(codes: np.ndarray, owner: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, each text's apart, and the rank of every place by its first 1, 2, 4, ... words.

    Only classes of more than one suffix are ordered further.
    """
    count = len(codes)
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    heads = np.append(True, np.diff(key[order]) != 0)
    rank = np.empty(count, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(count), 0))
    levels = [rank]
    slots = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    step = 1
    while len(slots):
        places = order[slots]
        after = places + step
        second = np.where(after < stop[places], rank[np.minimum(after, count - 1)] + 1, 0)
        key = rank[places] * (count + 1) + second
        again = np.argsort(key, kind="stable")
        places, key = places[again], key[again]
        order[slots] = places
        heads = np.append(True, np.diff(key) != 0)
        rank = rank.copy()
        rank[places] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(slots)), 0))]
        levels.append(rank)
        slots = slots[~(heads & np.append(heads[1:], True))]
        step *= 2
    return order, levels


def _common_lengths(order: np.ndarray, levels: list[np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes that share their first words, and how many words they share."""
    count = len(order)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    first, second = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for level in reversed(range(len(levels))):
        one, two = first + common, second + common
        inside = (one < stop[first]) & (two < stop[second])
        rank = levels[level]
        common += np.where(inside & (rank[np.minimum(one, count - 1)] == rank[np.minimum(two, count - 1)]), 1 << level, 0)
    return first, second, common


def word_runs(codes: np.ndarray, bounds: np.ndarray, *, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of several texts, ordered so; ``codes`` are their words one after another.

    A run with period p has at least max(least, power * p) words, so the suffixes at its first place and a period later share
    ``shortest`` words or more. Texts that repeat no such stretch are left alone: a hash of stretches picks out the others,
    and within those no class is united by fewer words.
    """
    shortest = min(max(least - p, (power - 1) * p, 1) for p in range(1, max(least, 2)))
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    places = np.arange(len(codes) - shortest + 1) if len(codes) >= shortest else np.zeros(0, np.int64)
    places = places[places + shortest <= bounds[owner[places] + 1]]
    if not len(places):
        return none
    stretch = owner[places].astype(np.uint64) * MIX
    for ahead in range(shortest):
        stretch = (stretch ^ (stretch >> np.uint64(29))) * MIX + codes[places + ahead].astype(np.uint64) + np.uint64(1)
    stretch = (stretch ^ (stretch >> np.uint64(32))) * MIX
    by_stretch = np.argsort(stretch)
    again = np.flatnonzero(np.diff(stretch[by_stretch]) == 0)
    texts = np.unique(owner[places[by_stretch[again]]])
    if not len(texts):
        return none
    chosen = np.zeros(len(counts), bool)
    chosen[texts] = True
    kept = chosen[owner]
    start = np.append(0, np.cumsum(counts[texts]))
    inner = np.repeat(np.arange(len(texts)), counts[texts])
    stop = start[inner + 1]
    order, levels = _ranks(codes[kept], inner, stop)
    first, second, common = _common_lengths(order, levels, stop)
    enough = common >= shortest
    first, second, common = first[enough], second[enough], common[enough]
    falling = np.argsort(-common, kind="stable")
    found = repetitions(first[falling].tolist(), second[falling].tolist(), common[falling].tolist(), least, power)
    if not found:
        return none
    table = np.array([(s, e, p) for (p, e), s in found.items()], np.int64)
    text = inner[table[:, 0]]
    begin, length, period = table[:, 0] - start[text], table[:, 1] - table[:, 0], table[:, 2]
    sort = np.lexsort((period, begin, text))
    return texts[text[sort]], begin[sort], length[sort], period[sort]


def _analysed(texts: pa.Array, least: int, power: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and text without repetitions of every text."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    flat = words.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    edges = np.asarray(words.offsets).astype(np.int64)
    bounds = np.append(0, np.cumsum(filled))[edges - edges[0]]
    flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    text, start, length, period = word_runs(codes, bounds, least=least, power=power)
    counts = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a) for a in (start, length, period)], names=RUN.names))
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, bounds[text] + start + period, 1)
    np.add.at(cover, bounds[text] + start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    left = np.append(0, np.cumsum(kept))[bounds]
    lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(kept)))
    return pa.array(np.diff(bounds)), runs, pc.binary_join(lists, " ")


def periodic_runs(reports: DataFrame, *, key: str = STACK, text: str = REPORT, least: int = LEAST, power: int = POWER) -> DataFrame:
    """One row per report: (key, n_words, runs, collapsed).

    ``runs`` lists the (start, length, period) of every stretch of words with smallest period p and at least
    max(``least``, ``power`` * p) words that cannot be extended, by start and then period; words are what white space of ASCII
    parts, numbered from 0. ``collapsed`` is the report without the words that any run holds after its first period, joined by
    one space. A text is taken whole in one task, in memory that grows with its words and the logarithm of its longest repeat.

    Null and empty reports have no words, no runs and an empty collapsed text; repeated rows and null keys come back as they
    are. No rows in, no rows out. Other columns are not read, whatever their names.
    """
    narrow = reports.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([
        narrow.schema["_key"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("_key"), *_analysed(part.column("_text"), least, power)], names=schema.names)

    return narrow.mapInArrow(run, schema).withColumnRenamed("_key", key)
