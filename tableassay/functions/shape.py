"""Wide to long: one row per (column position, value), in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.functions.schema import as_double, text, texts


def long_numbers(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``(idx, value)`` rows of the named columns as doubles, missing kept as NULL.

    ``idx`` is an integer so that the grouping that follows stays in the fast
    primitive-key hash map.  ``stack`` runs inside whole-stage code generation.
    """
    cells = ", ".join(f"{i}, {as_double(df, n)}" for i, n in enumerate(names))
    return df.selectExpr(*keep, f"stack({len(names)}, {cells}) AS (idx, value)")


def inline_columns(row: DataFrame, names: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """One output row per column from a one-row wide aggregate.

    ``fields`` gives, per output field, the SQL over ``row`` for each column.
    """
    entries = []
    for i, n in enumerate(names):
        parts = ", ".join(f"'{k}', {sql[i]}" for k, sql in fields.items())
        entries.append(f"named_struct('column', {text(n)}, {parts})")
    return row.selectExpr(f"inline(array({', '.join(entries)}))")


def with_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace ``idx`` by the column name."""
    rest = [c for c in df.columns if c != "idx"]
    return df.select(F.expr(f"get({texts(names)}, idx)").alias("column"), *rest)
