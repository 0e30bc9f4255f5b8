"""Comparing two metric tables of text cells within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelgrain.functions.text import short_numbers

MISSING = "<missing>"
SHOWN = 20
NUMBER = "^\\\\s*[+-]?((\\\\d[\\\\d_]*(\\\\.[\\\\d_]*)?|\\\\.\\\\d[\\\\d_]*)([eE][+-]?\\\\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\\\\s*$"


def number(text: str) -> str:
    """SQL for the number a cell holds, null when it holds none."""
    return f"if({text} rlike '{NUMBER}', try_cast(replace({text}, '_', '') as double), null)"


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, empty cells kept, with the file's line order in ``_line``."""
    table = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    if not table.columns:
        raise ValueError(f"{path} does not contain a CSV header")
    # a split of a file is read from front to back in one task; splits themselves are read in any order
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")
    )
    return table.select("*", place.alias("_line"))


def with_positions(table: DataFrame) -> DataFrame:
    """Replace ``_line`` by 0, 1, 2... in its order without a global sort.

    ``_line`` is the place that ``read_metric_csv`` gives, or a number from ``monotonically_increasing_id``.
    """
    if isinstance(table.schema["_line"].dataType, T.StructType):
        part, place = F.struct("_line.file", "_line.start"), F.col("_line.place")
    else:
        part, place = F.expr("shiftright(_line, 33)"), F.col("_line")
    split = table.withColumns({"_part": part, "_place": place})
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("_part", (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_start"))
    return split.join(starts, "_part").withColumn("_line", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def _as_map(table: DataFrame, columns: Sequence[str]) -> Column:
    entries = [x for c in columns for x in (F.lit(c), F.col(c))]
    return F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")


def pair_rows(expected: DataFrame, actual: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, e, a) for rows on both sides, and differences for rows on one side only.

    Rows meet by key, the last of several with one key counting; without the key column on both
    sides they meet by position.
    """
    sides = []
    by_key = key in expected.columns and key in actual.columns
    for table, name in ((expected, "e"), (actual, "a")):
        columns = [c for c in table.columns if c != "_line"]
        if by_key:
            sides.append(
                table.select(F.col(key).alias("row_id"), _as_map(table, columns).alias(name), "_line")
                .groupBy("row_id").agg(F.max_by(name, "_line").alias(name))
            )
        else:
            placed = with_positions(table)
            sides.append(placed.select(F.col("_line").cast("string").alias("row_id"), _as_map(table, columns).alias(name)))
    both = sides[0].join(sides[1], "row_id", "full")
    pairs = both.where("e is not null and a is not null")
    if by_key:
        lone = both.where("e is null or a is null").select(
            "row_id", F.lit("__row__").alias("column"),
            F.expr("if(e is null, 'missing', 'present')").alias("expected"), F.expr("if(a is null, 'missing', 'present')").alias("actual"),
            F.lit(None).cast("double").alias("delta"),
        )
    else:
        counts = both.agg(F.count("e").alias("e"), F.count("a").alias("a")).where("e <> a")
        lone = counts.select(
            F.lit("*").alias("row_id"), F.lit("__row_count__").alias("column"), F.col("e").cast("string").alias("expected"),
            F.col("a").cast("string").alias("actual"), F.lit(None).cast("double").alias("delta"),
        )
    return pairs, lone


def compare_tables(
    expected: DataFrame, actual: DataFrame, *, key: str = "frame_index", tolerance: float = 1e-6,
    columns: Sequence[str] | None = None, all_columns: bool = False, nan_equal: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(differences, report) of two tables of text cells.

    Without named columns, those common to both sides are compared: all of them, or those whose
    cells are numbers in every paired row. Two numbers differ beyond the tolerance, anything else
    when the text differs. ``nan_equal`` lets a missing number (NaN) match any number.
    """
    pairs, lone = pair_rows(expected, actual, key)
    common = sorted((set(expected.columns) & set(actual.columns)) - {key, "_line"})
    wanted = list(columns) if columns else common
    have_e, have_a = set(expected.columns), set(actual.columns)
    present = [c for c in wanted if c in have_e and c in have_a]
    absent = [c for c in wanted if c not in present]
    names = F.array(*[F.lit(c) for c in present]) if present else F.expr("cast(array() as array<string>)")
    cells = pairs.select("row_id", F.explode(names).alias("column"), "e", "a").select(
        "row_id", "column", F.expr("e[column]").alias("expected"), F.expr("a[column]").alias("actual")
    ).withColumn("_e", F.expr(number("expected"))).withColumn("_a", F.expr(number("actual")))
    if not columns and not all_columns:
        numeric = cells.groupBy("column").agg(F.bool_and(F.expr("_e is not null and _a is not null")).alias("_ok")).where("_ok")
        # one row per column of the header, so its size is known
        cells = cells.join(F.broadcast(numeric.select("column")), "column", "left_semi")
    far = f"abs(_e - _a) > {tolerance}D" if not nan_equal else f"(abs(_e - _a) > {tolerance}D and not isnan(_e) and not isnan(_a))"
    judged = cells.withColumn(
        "differs", F.expr(f"if(_e is not null and _a is not null, {far} and not (_e = _a), not (expected <=> actual))")
    ).withColumn("delta", F.expr("if(_e is not null and _a is not null, abs(_e - _a), null)"))
    found = judged.where("differs").select("row_id", "column", "expected", "actual", "delta")
    for c in absent:
        found = found.unionByName(
            pairs.select(
                "row_id", F.lit(c).alias("column"), F.expr(f"coalesce(e['{c}'], '{MISSING}')").alias("expected"),
                F.expr(f"coalesce(a['{c}'], '{MISSING}')").alias("actual"), F.lit(None).cast("double").alias("delta"),
            )
        )
    differences = lone.unionByName(found)
    totals = ("compared_rows", "compared_cells", "difference_count")
    counted = [table.agg(F.count("*").alias(name)) for table, name in zip((pairs, judged, differences), totals)]
    together = counted[0].unionByName(counted[1], allowMissingColumns=True).unionByName(counted[2], allowMissingColumns=True)
    report = together.agg(*[F.max(name).alias(name) for name in totals]).withColumn("passed", F.expr("difference_count = 0"))
    return differences, report


def first_differences(differences: DataFrame, limit: int = SHOWN) -> DataFrame:
    """The first differences: rows on one side, then cells by row (numbers first) and column."""
    place = [
        F.expr("if(column = '__row__' and actual = 'missing', 0, if(column = '__row__', 1, 2))"),
        F.expr(f"if(column <> '__row__' and {number('row_id')} is null, 1, 0)"),
        F.expr(f"if(column = '__row__', null, {number('row_id')})"),
        F.col("row_id"), F.col("column"),
    ]
    return differences.orderBy(*place).limit(limit)


def report_text(report: DataFrame, differences: DataFrame, *, expected: str, actual: str, tolerance: float) -> DataFrame:
    """The report as numbered lines: totals, verdict, first differences and how many more there are."""
    head = report.select(
        F.posexplode(
            F.array(
                F.lit("CSV Validation"), F.lit(f"Expected: {expected}"), F.lit(f"Actual: {actual}"),
                F.lit(f"Tolerance: {tolerance:g}"), F.concat(F.lit("Rows compared: "), "compared_rows"),
                F.concat(F.lit("Cells compared: "), "compared_cells"),
                F.expr("concat('Result: ', if(passed, 'PASS', 'FAIL'))"),
            )
        ).alias("line_no", "line")
    )
    shown = short_numbers(first_differences(differences), ["delta"]).select(
        F.expr(f"row_number() over (order by if(column = '__row__' and actual = 'missing', 0, if(column = '__row__', 1, 2)), "
               f"if(column <> '__row__' and {number('row_id')} is null, 1, 0), if(column = '__row__', null, {number('row_id')}), row_id, column) + 99").alias("line_no"),
        F.expr(
            "concat('- row ', row_id, ', ', column, ': expected=', coalesce(expected, ''), ', actual=', coalesce(actual, ''), "
            "if(delta is null, '', concat(', delta=', t_delta)))"
        ).alias("line"),
    )
    more = report.where(f"difference_count > {SHOWN}").select(
        F.lit(1000).alias("line_no"), F.expr(f"concat('- ... ', difference_count - {SHOWN}, ' more differences')").alias("line")
    )
    return head.unionByName(shown).unionByName(more)
