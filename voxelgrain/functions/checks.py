"""Row checks that fail the job, or collect as text when a batch must go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raise_when(condition: str, message: str | Column, value: str) -> Column:
    """``value`` unless ``condition`` holds, in which case the job fails with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.expr(condition), F.raise_error(text)).otherwise(F.expr(value))


def require(df: DataFrame, bad: str, message: str | Column) -> DataFrame:
    """The same rows, failing the job when ``bad`` holds for one of them.

    The check is a filter, so it is not lost when a checked column turns out to be unused.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.expr(bad), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def first_error(*checks: tuple[str, str]) -> Column:
    """Text of the first failing check (condition, message expression), or null."""
    return F.coalesce(*[F.when(F.expr(cond), F.expr(text)) for cond, text in checks])
