"""Near duplicates among reports: SimHash fingerprints compared through tables of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.llm.records import REPORT, STACK, text_slices
from voxelgrain.operators.runs import connect
from voxelgrain.session import materialize

SHINGLE = 3
SEED = 42
REACH = 2
BLOCKS = 4
BASES = 8
DIRECT = 32
HASHES = 1 << 16
MARK_BITS = (16, 24)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_mask(block: int) -> int:
    width = 64 // BLOCKS
    return ((1 << width) - 1) << (block * width)


def pivots() -> list[int]:
    """Reference fingerprints: for every base the base itself and the base with one block of bits inverted.

    The distances to a base and to its inverse in a block differ by how far a fingerprint is from the base in that block.
    """
    bases = [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(BASES)]
    return [b ^ m for b in bases for m in (0, *map(block_mask, range(BLOCKS)))]


def fingerprint(text: str | None) -> int:
    """64 bits, each set if more than half of the shingle hashes set it; A-Z count as lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = min(SHINGLE, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        values = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def signed_fingerprint(text: str | None) -> int:
    return _signed(fingerprint(text))


def report_fingerprints(reports: DataFrame, *, key: str = STACK, text: str = REPORT) -> DataFrame:
    """(key, fp): the fingerprint of every report as a signed 64-bit integer."""
    narrow = reports.select(F.col(key), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField(key, narrow.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                values = [signed_fingerprint(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(values, pa.int64())], names=[key, "fp"])

    return narrow.mapInArrow(run, schema)


def pivot_table(fingerprints: DataFrame) -> DataFrame:
    """(fp, distances): Hamming distance of every different fingerprint to every pivot."""
    distances = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("tinyint") for p in pivots()])
    return fingerprints.select("fp", distances.alias("distances"))


def _block_distances(block: int) -> Column:
    """The distances to all bases within one block of bits, packed into one number."""
    width, step = 64 // BLOCKS, BLOCKS + 1
    packed = F.lit(0).cast("bigint")
    for base in range(BASES):
        whole, inverted = F.col("distances")[base * step], F.col("distances")[base * step + 1 + block]
        packed = packed * 32 + ((whole.cast("int") - inverted.cast("int") + width) / 2).cast("bigint")
    return packed


def _bucketed(table: DataFrame) -> DataFrame:
    """(pair, a, b, fp, distances): each fingerprint under its pivot distances in every pair of blocks.

    Two fingerprints that differ in at most BLOCKS - 2 bits agree in at least two blocks, hence in all distances there.
    """
    blocks = table.select("fp", "distances", *[_block_distances(i).alias(f"d{i}") for i in range(BLOCKS)])
    pairs = [F.struct(F.lit(n).alias("pair"), F.col(f"d{i}").alias("a"), F.col(f"d{j}").alias("b")) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return blocks.select("fp", "distances", F.explode(F.array(*pairs)).alias("k")).select("k.pair", "k.a", "k.b", "fp", "distances")


def _free_bits(pair: int) -> list[int]:
    used = list(combinations(range(BLOCKS), 2))[pair]
    width = 64 // BLOCKS
    return [bit for bit in range(64) if bit // width not in used]


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of at most REACH differing bits, enough to connect all that link.

    Buckets of few fingerprints are compared pair by pair: the largest difference of their distances to any pivot discards,
    the count of differing bits verifies. In larger ones every fingerprint also names its neighbours at one bit in the
    blocks that the bucket leaves free; those that share a neighbour link to the least of them, at most 33 at a time.
    """
    where = ["pair", "a", "b"]
    entries = _bucketed(pivot_table(fingerprints))
    counts = entries.groupBy(*where).agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(entries.join(counts, where))
    few = shared.where(F.col("members") <= DIRECT)
    one, two = few.alias("l"), few.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in where]
    apart = F.exists(F.zip_with("l.distances", "r.distances", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d > REACH)
    pairs = one.join(two, [*same, F.col("l.fp") < F.col("r.fp")]).where(~apart).where(
        F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= REACH
    )
    direct = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)).cast("bigint") for b in _free_bits(p)]) for p in range(len(list(combinations(range(BLOCKS), 2))))])
    many = shared.where(F.col("members") > DIRECT).select(*where, "fp", F.explode(flips[F.col("pair")]).alias("flip"))
    stars = many.groupBy(*where, F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).agg(F.collect_set("fp").alias("fps"))
    around = stars.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return direct.unionByName(around).distinct()


def _rooted(prints: DataFrame, key: str) -> DataFrame:
    """The written (fp, least, root): every different fingerprint, its smallest key and the fingerprint its group is known by."""
    different = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connect(near_links(different.select("fp")), [])
    rooted = different.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(rooted)


def near_groups(reports: DataFrame, *, key: str = STACK, text: str = REPORT) -> DataFrame:
    """One row per report: (key, fp, component_id).

    Reports link when their fingerprints differ in at most two bits; ``component_id`` is the smallest key that a report
    reaches through links, itself included. Null and empty texts have fingerprint zero and link like any other; a null key
    is never smallest unless all are null; repeated rows repeat. No rows in, no rows out. Other columns are not read.
    """
    prints = materialize(report_fingerprints(reports, key=key, text=text))
    rooted = _rooted(prints, key)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    components = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(components, "fp").select(key, "fp", "component_id")


def text_names(text: Column) -> tuple[Column, Column]:
    """Two 64-bit numbers that name a whole text."""
    return F.xxhash64(text).alias("name"), F.xxhash64(F.lit(SEED), text).alias("more")


def only_marked(reports: DataFrame, marked: DataFrame, *, key: str, text: str) -> DataFrame:
    """The ``reports`` that ``marked`` (_key, name, more, rows, stays) lets stay, with all their columns.

    Reports are known by key and text, ``rows`` of them by the same. A bit filter of bounded size lets most of those that stay pass
    where they are read; only what it holds back is compared with the names of reports that go. Of several that share key and text
    the first by their other columns stays.
    """
    known = ["_key", "name", "more"]
    marked = materialize(marked.where("not stays or rows > 1").select(*known, "stays"))
    bits = min(max((16 * marked.count()).bit_length(), MARK_BITS[0]), MARK_BITS[1])
    place = F.pmod(F.col("name"), F.lit(1 << bits))
    at, bit = (place / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(name, 64) as int))")
    # one row for each 64 bits, so no more than 2^(MARK_BITS - 6) rows are broadcast
    words = F.broadcast(marked.groupBy(at).agg(F.bit_or(bit).alias("word")))
    named = reports.select(F.struct(*[F.col(f"`{n}`") for n in reports.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), *text_names(F.col(f"`{text}`")))
    tested = named.withColumn("at", at).join(words, "at", "left").withColumn("hit", F.coalesce(F.col("word").bitwiseAND(bit) != 0, F.lit(False)))
    hits = materialize(tested.where("hit").select("_row", *known))
    same = F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in known))
    passed = hits.alias("l").join(marked.select(*known).alias("r"), same, "left_anti").select("_row")
    again = hits.alias("l").join(marked.where("stays").select(*known).alias("r"), same, "left_semi")
    single = again.groupBy(*known).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return tested.where("not hit").select("_row").unionByName(passed).unionByName(single).select("_row.*")


def first_of_groups(reports: DataFrame, members: DataFrame, *, key: str, text: str) -> DataFrame:
    """Of ``reports`` one for each group of ``members`` (_key, name, more, root), which has a row for each report: the smallest key, a
    null key last, then the smallest name of its text."""
    known = ["_key", "name", "more"]
    order = F.struct(F.col("_key").isNull().alias("none"), *known)
    counted = members.groupBy("root", *known).agg(F.count("*").alias("rows")).withColumn("order", order)
    first = counted.groupBy("root").agg(F.min("order").alias("first"))
    marked = counted.join(first, "root").select(*known, "rows", (F.col("order") == F.col("first")).alias("stays"))
    return only_marked(reports, marked, key=key, text=text)


def drop_near_copies(reports: DataFrame, *, key: str = STACK, text: str = REPORT) -> DataFrame:
    """One report for each group of linked ones, the one with the smallest key, with all its columns.

    A null key is never smallest unless all are null; of rows that share the smallest key the smallest name of a text stays. Groups
    are known by their fingerprints and rows by key and text, so reports that share a key or have none stay if nothing links them.
    """
    named = reports.select(F.struct(F.col(f"`{key}`").alias("_key"), *text_names(F.col(f"`{text}`"))).alias("_id"), F.col(f"`{text}`").alias("_text"))
    prints = report_fingerprints(named, key="_id", text="_text")
    prints = materialize(prints.select("_id.*", "fp"))
    members = prints.join(_rooted(prints, "_key").select("fp", "root"), "fp").select("_key", "name", "more", "root")
    return first_of_groups(reports, members, key=key, text=text)
