"""Small constant tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, columns: dict[str, str], rows: Iterable[Sequence]) -> DataFrame:
    """A table of literal rows, ``columns`` giving names and types.

    Spark knows the size of such a table, so it is broadcast without a hint.
    """
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    typed = ", ".join(f"cast({name} AS {kind}) AS {name}" for name, kind in columns.items())
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({', '.join(columns)})")
