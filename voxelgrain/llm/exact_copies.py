"""Exact duplicates among reports, with frequent texts handled apart from the ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.near_copies import only_marked, text_names
from voxelgrain.llm.records import REPORT, STACK, lower_ascii
from voxelgrain.session import materialize

HEAVY = 256
TRACKED = 4096


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def _frequent(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """At most ``heavy`` digests with their exact count and the row that stays.

    The candidates come from a mergeable Misra-Gries summary of ``tracked`` counters; every digest with more
    than its share of the counters is among them. Counting them again over all rows verifies them.
    """
    summary = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    candidates = summary.select(F.explode(F.transform("top", lambda t: t["item"])).alias("digest"))
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size")
    )
    return counted.where("group_size > 1")


def _decided(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """(id, digest, row, stays, group_size) of every one of the written rows (id, digest, row)."""
    known = F.broadcast(materialize(_frequent(rows, heavy, tracked)))
    marked = rows.join(known, "digest")
    rest = rows.join(known.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size"))
    columns = ["id", "digest", "row", "stays", "group_size"]
    return marked.select(*columns).unionByName(rest.join(groups, "digest").select(*columns))


def copy_groups(
    reports: DataFrame, *, key: str = STACK, text: str = REPORT, heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per report: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest key stays, a null key below all others; of rows that share text and key exactly one stays. Other columns
    of ``reports`` are not read, whatever their names. No rows in, no rows out.

    Only keys and digests are shuffled. ``heavy`` bounds the table that is broadcast.
    """
    rows = materialize(
        reports.select(F.col(key).alias("id"), text_digest(F.col(text)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    return _decided(rows, heavy, tracked).select(
        F.col("id").alias(key), F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(
    reports: DataFrame, *, key: str = STACK, text: str = REPORT, heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """The reports that stay, with all their columns: one row for each group of ``copy_groups``.

    Of rows that share text and key the first by their other columns stays, whatever runs again. Only keys, digests and names of
    texts are shuffled; those of rows that go meet the texts. Other columns may have any names; no rows in, no rows out.
    """
    name, more = text_names(F.col(f"`{text}`"))
    identity = F.struct(F.col(f"`{key}`").alias("_key"), name, more)
    rows = materialize(
        reports.select(F.col(f"`{key}`").alias("id"), text_digest(F.col(f"`{text}`")).alias("digest"), identity.alias("row"))
    )
    decided = _decided(rows, heavy, tracked)
    marked = decided.groupBy("row").agg(F.count("*").alias("rows"), F.first(F.expr("row <=> stays.row")).alias("stays")).select("row.*", "rows", "stays")
    return only_marked(reports, marked, key=key, text=text)
