"""Whole rows as prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import plain_key, plain_value


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_value_text(df: DataFrame, names: list[str]) -> Column:
    """One ``key: value`` line per column, numbers in plain decimal form.

    The first line passes through a lambda, which keeps the projection out of whole-stage
    code: there many columns make one method that the JVM refuses to compile, while code for a
    projection of its own is split into small methods.
    """
    lines = [F.concat(F.lit(f"{plain_key(c)}: "), plain_value(F.col(_quoted(c)), df.schema[c].dataType))
             for c in names]
    return F.concat_ws("\n", F.transform(F.array(*lines[:1]), lambda line: line), *lines[1:])


def dict_text(names: list[str]) -> Column:
    """The columns as one JSON object."""
    return F.to_json(F.struct(*[F.col(_quoted(c)) for c in names]))


def importance_text(importances: DataFrame) -> DataFrame:
    """One row ``importances``: a line per feature in table order (``position``).

    As many lines as the model has features, so the single group is bounded by the schema.
    """
    line = F.concat(F.col("feature"), F.lit(": "), plain_value(F.col("importance"),
                    importances.schema["importance"].dataType))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("text"))))
    return importances.agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("importances"))
