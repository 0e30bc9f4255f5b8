"""Similarity join of texts on sets of word shingles: rare shingles first, filters on length, place and the rest of the sets."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm.near_copies import near_links, signed_fingerprint, text_names
from voxelgrain.llm.records import REPORT, STACK, Shared, text_slices
from voxelgrain.operators.runs import connect
from voxelgrain.session import materialize

SHINGLE = 4
PERCENT = 85
HELD = 1 << 20
SLICE_BYTES = 1 << 18
ROWS_AT_ONCE = 512
OFTEN = 4
COMMON = 1 << 20
SLOT_BITS, BUCKET_BITS = 32, 24
FAR = np.uint32(0xFFFF)
FILTER_BITS = (22, 27)
PARITY_BITS = 1024
QUARTERS = 16
WITHOUT_WORDS = -1
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def shingle_codes(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different 64-bit shingle codes of every text; A-Z count as lower case, words end at white space.

    A text of fewer words is one shingle, one without words none.
    """
    encoded = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begin)
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1))
    counts = np.diff(np.searchsorted(starts, bounds))
    words = np.zeros(0, np.uint64)
    if len(starts):
        first = (np.cumsum(inside) - 1)[starts]
        letters = data[inside].astype(np.uint64)
        lengths = np.diff(np.append(first, len(letters)))
        powers = np.cumprod(np.full(int(lengths.max()), MIX, np.uint64))
        words = np.add.reduceat((letters + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(first, lengths)], first)
        words = (words ^ (words >> np.uint64(31))) * MIX
        words ^= words >> np.uint64(29)
    out, at = [], 0
    for count in counts.tolist():
        own = words[at : at + count]
        at += count
        size = min(shingle, count)
        total = np.full(count - size + 1 if count else 0, size, np.uint64)
        for place in range(size):
            total = (total + own[place : place + len(total)]) * MIX
            total ^= total >> np.uint64(32)
        out.append(np.unique(total))
    return out


def set_name(codes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a shingle set."""
    names = []
    for turn in (np.uint64(27), np.uint64(33)):
        mixed = (codes ^ (codes >> turn)) * MIX
        mixed = (mixed ^ (mixed >> np.uint64(30))) * (MIX + turn + turn)
        total = int((mixed ^ (mixed >> np.uint64(31))).sum(dtype=np.uint64)) * (2 * len(codes) + 1) & (1 << 64) - 1
        names.append(total - (1 << 64) if total >> 63 else total)
    return names[0], names[1]


def parity(codes: np.ndarray) -> np.ndarray:
    """One bit for each of PARITY_BITS classes of shingles: is their number odd? Sets that differ in d shingles differ in at most d bits."""
    odd = np.bincount((codes >> np.uint64(44)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class JoinRule:
    """Two sets link when 100 * shared >= percent * together. Shingles known to be common come last in the order of shingles, by
    the number of texts counted for the first 32 bits of their code; all others come before them by their code."""

    def __init__(self, shingle: int, percent: int, slots: np.ndarray | None = None, counts: np.ndarray | None = None):
        given = slots is not None and len(slots)
        order = np.argsort(slots) if given else np.zeros(0, np.int64)
        self.slots = slots[order].astype(np.uint32) if given else np.zeros(0, np.uint32)
        self.counts = counts[order].astype(np.uint32) if given else np.zeros(0, np.uint32)
        self.shingle, self.percent = shingle, percent

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """The rarest shingles, rarest first: as many as any other set that links must share one of; none where no other can link."""
        size = len(codes)
        if 100 * size < self.percent * (size + 1):
            return codes[:0]
        length = size - -(-self.percent * size // 100) + 1
        if not len(self.slots):
            return codes[:length]
        own = (codes >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)
        place = np.minimum(np.searchsorted(self.slots, own), len(self.slots) - 1)
        counts = np.where(self.slots[place] == own, self.counts[place], 0)
        return codes[np.argsort(counts, kind="stable")[:length]]

    def linked(self, one: np.ndarray, two: np.ndarray) -> bool:
        """Do two sorted sets link? The suffix filter first: how far cuts at some shingles of one set are from those of the other."""
        most = len(one) + len(two) - 2 * -(-self.percent * (len(one) + len(two)) // (100 + self.percent))
        cuts = np.linspace(0, len(two), QUARTERS + 1).astype(np.int64)
        there = np.append(np.append(0, np.searchsorted(one, two[cuts[1:-1]])), len(one))
        if int(np.abs(np.diff(there) - np.diff(cuts)).sum()) > most:
            return False
        both = np.sort(np.concatenate([one, two]), kind="stable")
        same = int((both[1:] == both[:-1]).sum())
        return 100 * same >= self.percent * (len(both) - same)

    # sizes s <= t, number of shingles before the shared one i and j
    def lengths_fit(self, s: str, t: str) -> Column:
        return F.expr(f"100 * {s} >= {self.percent} * {t}")

    def places_fit(self, s: str, i: str, t: str, j: str) -> Column:
        return F.expr(f"{100 + self.percent} * least({s} - {i}, {t} - {j}) >= {self.percent} * ({s} + {t})")

    def leads(self) -> Column:
        """May this shingle be the first that the set shares with a set of the same size or a larger one?"""
        return self.places_fit("size", "pos", "size", "pos")

    def parities_fit(self, s: str, t: str, x: str, y: str) -> Column:
        need = f"({self.percent} * ({s} + {t}) + {99 + self.percent}) div {100 + self.percent}"
        apart = f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (n, b) -> n + b)"
        return F.expr(f"{apart} <= {s} + {t} - 2 * ({need})")


def packed_slots(slots: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted numbers as steps of 16 bits; wider ones stand apart."""
    steps = np.diff(slots, prepend=np.uint32(0)).astype(np.uint32)
    wide = steps >= FAR
    return np.where(wide, FAR, steps).astype("<u2").tobytes(), steps[wide].astype("<u4").tobytes()


def unpacked_slots(near: bytes | pa.Buffer, far: bytes | pa.Buffer) -> np.ndarray:
    steps = np.frombuffer(near, "<u2").astype(np.int64)
    steps[steps == FAR] = np.frombuffer(far, "<u4")
    return np.cumsum(steps)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS_AT_ONCE) -> Iterator[None]:
    """Tables written inside hand their rows to Python in batches of so many, since a row may be a whole text or two whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts): in how many texts shingles occur, by the first 32 bits of their codes, for the COMMON most frequent ones of
    at least OFTEN. All shingles of all texts are counted; the counts only order the shingles.

    Tasks send the slots of their texts as small steps, about two bytes for each shingle, and a range of slots is counted in one
    array of fixed size.
    """
    low = (1 << BUCKET_BITS) - 1

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(held))
        edges = np.searchsorted(slots, np.arange(1 << (SLOT_BITS - BUCKET_BITS), dtype=np.uint32) << np.uint32(BUCKET_BITS))
        parts = [(n, p & np.uint32(low)) for n, p in enumerate(np.split(slots, edges[1:])) if len(p)]
        packed = [packed_slots(p) for _, p in parts]
        arrays = [pa.array([n for n, _ in parts], pa.int32()), *[pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1)]]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "near", "far"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                for codes in shingle_codes(part.column("_text").to_pylist(), shingle):
                    held.append((codes >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                    size += len(codes)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def often(bucket: int, counts: np.ndarray) -> pa.RecordBatch:
        many = np.flatnonzero(counts >= OFTEN)
        numbers = [pa.array(many + (bucket << BUCKET_BITS)), pa.array(counts[many].astype(np.int64))]
        counts[:] = 0
        return pa.RecordBatch.from_arrays(numbers, names=["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            for bucket, near, far in zip(*(batch.column(c) for c in ("bucket", "near", "far")), strict=True):
                bucket = bucket.as_py()
                if bucket != current and current is not None:
                    yield often(current, counts)
                current = bucket
                found = unpacked_slots(near.as_buffer(), far.as_buffer())
                heads = np.flatnonzero(np.diff(found, prepend=-1))
                counts[found[heads]] += np.diff(np.append(heads, len(found))).astype(np.uint32)
        if current is not None:
            yield often(current, counts)

    sent = texts.select("_text").mapInArrow(slots, "bucket int, near binary, far binary")
    counted = sent.repartition(1 << (SLOT_BITS - BUCKET_BITS), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "slot bigint, n bigint")
    table = counted.orderBy(F.desc("n"), "slot").limit(COMMON).toArrow()
    return table.column("slot").to_numpy(), table.column("n").to_numpy()


def _surveyed(texts: DataFrame, rule: JoinRule, prints: bool = False) -> DataFrame:
    """The written (_n, _key, size, name, more, digest, other, prefix, parity) of every text; digest and other name the text itself.

    With ``prints`` there is also fp, the text's fingerprint.
    """
    shared = Shared(texts.sparkSession, rule)
    names = ["_n", "_key", "size", "name", "more", "digest", "other", "prefix", "parity", *["fp"] * prints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                held_texts = part.column("_text").to_pylist()
                sets = shingle_codes(held_texts, own.shingle)
                called = [set_name(c) for c in sets]
                first = [own.prefix(c).view(np.int64) for c in sets]
                # a set without prefix is in no pair
                bits = [parity(c) if len(f) else f for c, f in zip(sets, first, strict=True)]
                lists = []
                for held in (first, bits):
                    edges = np.append(0, np.cumsum([len(h) for h in held])).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))))
                columns = [
                    part.column("_n"), part.column("_key"), pa.array([len(c) for c in sets], pa.int64()), pa.array([n for n, _ in called], pa.int64()),
                    pa.array([m for _, m in called], pa.int64()), part.column("digest"), part.column("other"), *lists,
                ]
                if prints:
                    columns.append(pa.array([signed_fingerprint(t) for t in held_texts], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    key = texts.schema["_key"].dataType.simpleString()
    schema = f"_n bigint, _key {key}, size bigint, name bigint, more bigint, digest bigint, other bigint, prefix array<bigint>, parity array<bigint>"
    schema += ", fp bigint" if prints else ""
    digest, other = text_names(F.col("_text"))
    numbered = texts.withColumn("_n", F.monotonically_increasing_id())
    return materialize(numbered.withColumns({"digest": digest, "other": other}).mapInArrow(run, schema))


def _sets(texts: DataFrame, pairs: DataFrame, survey: DataFrame, shingle: int) -> DataFrame:
    """The written (id, codes): the shingle sets that pairs name. A bit filter of bounded size keeps most other texts from being read
    and their sets from the shuffle; it lets others through, and the join takes those out."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    wanted = materialize(survey.join(ids, "_n").select(F.col("_n").alias("id"), "name", "more", "digest"))
    low, high = FILTER_BITS
    bits = min(max((16 * wanted.count()).bit_length(), low), high)
    place = F.pmod("digest", F.lit(1 << bits))
    words = wanted.groupBy((place / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(digest, 64) as int))")).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for at, word in words.toLocalIterator():
        table[at] = word
    held = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = held.value.view(np.uint64)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            spot = batch.column("digest").to_numpy().view(np.uint64) & np.uint64(64 * len(some) - 1)
            chosen = (some[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)
            for part in text_slices(batch.filter(pa.array(chosen.astype(bool))), "_text", SLICE_BYTES):
                named = [(*set_name(c), c) for c in shingle_codes(part.column("_text").to_pylist(), shingle)]
                fresh = {(n, m): c.tobytes() for n, m, c in named if (n, m) not in seen}
                seen.update(fresh)
                columns = [pa.array([k[i] for k in fresh], pa.int64()) for i in (0, 1)] + [pa.array(list(fresh.values()), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "more", "codes"])

    found = texts.select("_text", F.xxhash64("_text").alias("digest")).mapInArrow(run, "name bigint, more bigint, codes binary")
    return materialize(found.join(wanted.select("id", "name", "more"), ["name", "more"]).groupBy("id").agg(F.first("codes").alias("codes")))


def _verified(pairs: DataFrame, sets: DataFrame, rule: JoinRule) -> DataFrame:
    """The written (a, b): the pairs that link by their whole sets."""
    shared = Shared(pairs.sparkSession, JoinRule(rule.shingle, rule.percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            good = [
                own.linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(i), F.col("codes").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def _candidates(pairs: DataFrame, different: DataFrame, rule: JoinRule) -> DataFrame:
    """The written (a, b): pairs whose parities do not rule a link out."""
    left, right = (different.select(F.col("_n").alias(i), F.col("parity").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(left, "a").join(right, "b").where(rule.parities_fit("s", "t", "x", "y")).select("a", "b"))


def print_links(texts: DataFrame, survey: DataFrame, different: DataFrame, rule: JoinRule) -> DataFrame:
    """The written (a, b): links that the fingerprints of ``different`` point to.

    Tables of distances to pivots name the fingerprints that differ in few bits. Every set is compared with the least one of its
    own fingerprint, and the least ones of near fingerprints with each other, by their whole sets.
    """
    named = different.select(F.col("_n").alias("id"), "size", "fp")
    least = materialize(named.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("m")).select("fp", "m.*"))
    own = least.alias("l").join(named.alias("r"), "fp").where("l.id <> r.id")
    near = materialize(near_links(least.select("fp")))
    left, right = (least.select(F.col("fp").alias(f), F.col("id").alias(i), F.col("size").alias(n)) for f, i, n in (("a", "p", "s"), ("b", "q", "t")))
    across = near.join(left, "a").join(right, "b").select(F.col("p").alias("a"), F.col("q").alias("b"), "s", "t")
    pairs = own.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.size").alias("s"), F.col("r.size").alias("t")).unionByName(across)
    able = _candidates(pairs.where(rule.lengths_fit("least(s, t)", "greatest(s, t)")), different, rule)
    return _verified(able, _sets(texts, able, survey, rule.shingle), rule)


def same_prints(survey: DataFrame, same: DataFrame) -> DataFrame:
    """The written (a, b): links between the ids of ``same`` whose texts have fingerprints of at most REACH differing bits, enough to
    connect all of them, whatever their sets have in common.

    Every text counts, since texts of one set may have several fingerprints. Texts without words have the id WITHOUT_WORDS.
    """
    filled = survey.where("size > 0").join(same, ["name", "more"]).select("fp", "id")
    held = materialize(filled.unionByName(survey.where("size = 0").select("fp", F.lit(WITHOUT_WORDS).cast("bigint").alias("id"))).distinct())
    least = materialize(held.groupBy("fp").agg(F.min("id").alias("least")))
    own = held.join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    left, right = (least.select(F.col("fp").alias(f), F.col("least").alias(i)) for f, i in (("a", "p"), ("b", "q")))
    across = near_links(least.select("fp")).join(left, "a").join(right, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return materialize(own.unionByName(across).where("a <> b").distinct())


def _stars(links: DataFrame) -> DataFrame:
    """The written (a, b): what ``links`` connect, every id but the least as a, the least that it reaches as b."""
    return materialize(connect(links, []).select(F.col("node").alias("a"), F.col("root").alias("b")))


def _between_roots(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, ...) that ``stars`` do not connect, with the least ids that both reach, _x and _y."""
    left, right = (stars.select(F.col("a").alias(i), F.col("b").alias(r)) for i, r in (("a", "_x"), ("b", "_y")))
    rooted = pairs.join(left, "a", "left").join(right, "b", "left")
    return rooted.withColumns({"_x": F.coalesce("_x", "a"), "_y": F.coalesce("_y", "b")}).where("_x <> _y")


def _still_apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, ...) that ``stars`` do not connect."""
    return _between_roots(pairs, stars).drop("_x", "_y")


def _joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The written stars of ``stars`` and ``links`` together; only what links different stars is connected anew."""
    more = _stars(_between_roots(links, stars).select(F.col("_x").alias("a"), F.col("_y").alias("b")))
    moved = stars.join(more.select(F.col("a").alias("b"), F.col("b").alias("least")), "b", "left")
    return materialize(moved.select("a", F.coalesce("least", "b").alias("b")).unionByName(more))


def similar_links(texts: DataFrame, survey: DataFrame, different: DataFrame, rule: JoinRule, known: DataFrame | None = None) -> DataFrame:
    """The written (a, b): every set that links to one of a smaller id, and the least id that it reaches.

    Sets that link share a shingle of their prefixes, so they meet under the first one they share; the smaller of both knows it
    within the even shorter part of its prefix that leaves room for a set at least as large. All sets under a shingle are first
    compared with the one that has fewest rarer shingles, the nearest to what they have in common. Only sets that are still apart
    afterwards are compared with each other, so a group of near copies costs its size and not its square. A pair counts once, and
    only while lengths, places and parities allow a link. ``known`` links come first; what they connect is not compared again.
    """
    entries = different.select(F.posexplode("prefix").alias("pos", "code"), F.col("_n").alias("id"), "size")
    several = entries.groupBy("code").agg(F.count("*").alias("n"), F.bool_or(rule.leads()).alias("led")).where("n > 1 and led").select("code")
    shared = materialize(entries.join(materialize(several), "code"))

    def fit(one: str, two: str) -> Column:
        return rule.lengths_fit(f"{one}.size", f"{two}.size") & rule.places_fit(f"{one}.size", f"{one}.pos", f"{two}.size", f"{two}.pos")

    def pair(one: str, two: str) -> list[Column]:
        return [F.col(f"{one}.id").alias("a"), F.col(f"{two}.id").alias("b"), F.col(f"{one}.size").alias("s"), F.col(f"{two}.size").alias("t")]

    ordered = "(l.size < r.size or l.size = r.size and l.id < r.id)"
    middle = shared.groupBy("code").agg(F.min(F.struct("pos", "size", "id")).alias("m")).select("code", "m.*")
    met = middle.alias("l").join(shared.alias("r"), "code").where("l.id <> r.id")
    names = ("id", "size", "pos")
    smaller = F.expr(f"if({ordered}, struct({', '.join('l.' + n for n in names)}), struct({', '.join('r.' + n for n in names)}))")
    larger = F.expr(f"if({ordered}, struct({', '.join('r.' + n for n in names)}), struct({', '.join('l.' + n for n in names)}))")
    sorted_pairs = met.select(smaller.alias("one"), larger.alias("two")).where(fit("one", "two"))
    tried = materialize(sorted_pairs.select(*pair("one", "two")).distinct())
    stars = None if known is None else _stars(known)
    near = _candidates(tried if stars is None else _still_apart(tried, stars), different, rule)
    links = _verified(near, _sets(texts, near, survey, rule.shingle), rule)
    stars = _stars(links) if stars is None else _joined(stars, links)
    roots = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
    rooted = materialize(shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = rooted.groupBy("code").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("code")
    apart = rooted.join(mixed, "code").join(different.select(F.col("_n").alias("id"), "parity"), "id")
    apart = materialize(apart.select("code", "id", "size", "pos", "root", "parity", rule.leads().alias("lead")))
    allowed = fit("l", "r") & F.expr(ordered) & F.expr("l.root <> r.root") & rule.parities_fit("l.size", "r.size", "l.parity", "r.parity")
    rest = apart.where("lead").alias("l").join(apart.alias("r"), (F.col("l.code") == F.col("r.code")) & allowed)
    others = materialize(rest.select(*pair("l", "r")).distinct().join(tried, ["a", "b"], "left_anti").select("a", "b"))
    return _joined(stars, _verified(others, _sets(texts, others, survey, rule.shingle), rule))


def similar_classes(texts: DataFrame, shingle: int, percent: int, *, prints: bool = False, verify: bool = True) -> DataFrame:
    """The written (_key, name, more, size, root) of texts (_key, _text): two numbers that name the text, the size of its shingle set
    and the class, which is null for an empty set.

    With ``prints`` the near fingerprints are searched first, and the join of shingles adds the links that they miss. Without
    ``verify`` near fingerprints link by themselves, and the class of what links to texts without words is WITHOUT_WORDS.
    """
    with small_batches(texts.sparkSession):
        rule = JoinRule(shingle, percent, *_common(texts, shingle))
        survey = _surveyed(texts, rule, prints)
        # copies count once: one row stands for all with the same set
        same = materialize(survey.where("size > 0").groupBy("name", "more").agg(F.min("_n").alias("id")))
        # written, since a dozen joins read it and each would shuffle all prefixes and parities again
        first = survey.join(same.select(F.col("id").alias("_n")), "_n", "left_semi").where(F.size("prefix") > 0)
        different = materialize(first.select("_n", "size", "prefix", "parity", *["fp"] * prints))
        known = None
        if prints:
            known = print_links(texts, survey, different, rule) if verify else same_prints(survey, same)
        stars = similar_links(texts, survey, different, rule, known)
        roots = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
        classes = same.join(roots, "id", "left").select("name", "more", F.coalesce("root", "id").alias("root"))
        filled = survey.where("size > 0").join(classes, ["name", "more"])
        # empty sets meet nothing, so they stay out of the joins
        empty = survey.where("size = 0").withColumn("root", F.lit(None).cast("bigint"))
        own = ["_key", F.col("digest").alias("name"), F.col("other").alias("more"), "size", "root"]
        return materialize(filled.select(*own).unionByName(empty.select(*own)))


def shingle_groups(reports: DataFrame, *, key: str = STACK, text: str = REPORT, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per report: (key, n_shingles, component_id).

    A report's set holds its different runs of ``shingle`` words, in lower case of A-Z; fewer words are one shingle. Two reports
    link when 100 * shared shingles >= ``percent`` * shingles of both together. ``component_id`` is the smallest key that a report
    reaches through links, itself included. A report without words, null or empty, has an empty set and links with nothing.

    A null key is never smallest unless all are null; repeated rows repeat. No rows in, no rows out. Other columns are not read.
    A text is taken whole in one task. Only shingle prefixes, names of sets and the sets of candidate pairs are shuffled.
    """
    texts = reports.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    members = similar_classes(texts, shingle, percent)
    filled = members.where("root is not null")
    least = filled.groupBy("root").agg(F.min("_key").alias("component_id"))
    alone = members.where("root is null").withColumn("component_id", F.col("_key"))
    found = filled.join(least, "root").select("_key", "size", "component_id").unionByName(alone.select("_key", "size", "component_id"))
    return found.select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), "component_id")
