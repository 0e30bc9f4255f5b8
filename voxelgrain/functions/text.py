"""Text forms: short numbers for reports, file names for outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def short_numbers(df: DataFrame, columns: Sequence[str], prefix: str = "t_") -> DataFrame:
    """Add each double column as text (named with ``prefix``): six significant digits, no trailing zeros.

    Exponents below -4 or above 5 use scientific notation with at least two exponent digits. The
    steps are separate columns so that none is computed twice.
    """
    # number patterns round the exact binary value half to even, save whole numbers that lie exactly
    # between two results; those are moved by one towards the even digit
    unit = "pow(10D, floor(log10(abs({0}))) - 5)"
    middle = f"abs({{0}}) >= 1e6D and abs({{0}}) < 1e15D and {{0}} = floor({{0}}) and abs({{0}}) % {unit} = {unit} / 2"
    nudged = f"if({middle}, {{0}} + signum({{0}}) * if(floor(abs({{0}}) / {unit}) % 2 = 0, -1, 1), cast({{0}} as double))"
    exponent = "cast(substring_index(format_number(_n_{0}, '0.00000E0'), 'E', -1) as int)"
    fixed = " ".join(f"when {e} then format_number(_n_{{0}}, '{'0.' + '#' * (5 - e) if e < 5 else '0'}')" for e in range(-4, 6))
    scientific = "regexp_replace(replace(format_number(_n_{0}, '0.#####E00'), 'E', 'e'), 'e([0-9])', 'e+$1')"
    shown = (
        "case when {0} is null then null when {0} = 0 then '0' when isnan({0}) then 'nan' "
        f"else case _e_{{0}} {fixed} else {scientific} end end"
    )
    for template, name in ((nudged, "_n_"), (exponent, "_e_"), (shown, prefix)):
        df = df.withColumns({f"{name}{c}": F.expr(template.format(c)) for c in columns})
    return df.drop(*[f"{p}{c}" for p in ("_n_", "_e_") for c in columns])


def safe_stem(path: str) -> str:
    """SQL for a path's file name without suffix, anything but letters, digits, ._- replaced by _."""
    name = f"regexp_extract({path}, '([^/]*)$', 1)"
    stem = f"trim(regexp_replace({name}, '(.)[.][^.]*$', '$1'))"
    return f"regexp_replace(coalesce(nullif({stem}, ''), 'stack'), '[^\\\\p{{L}}\\\\p{{N}}._-]', '_')"


def bundle_folder(path: str) -> str:
    """SQL for the nested output folder of a relative source path, every part made safe."""
    bare = f"regexp_replace({path}, '([^/])[.][^./]*$', '$1')"
    return f"array_join(transform(split({bare}, '/'), part -> {safe_stem('part')}), '/')"
