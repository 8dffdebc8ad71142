"""Column dropping, null handling, encoding and scaling of whole frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import to_number
from tessera.operators.ranking import value_rank
from tessera.session import cut_lineage

INLINE_CODES = 64


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def drop_columns(df: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """Drop columns; unknown names raise when ``strict``, else are ignored."""
    if strict:
        _require(df, names)
    return df.select(*[col(c) for c in df.columns if c not in names])


def trim_names(df: DataFrame) -> DataFrame:
    """Remove blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def trim_values(df: DataFrame) -> DataFrame:
    """Remove blanks around the values of string columns."""
    return df.select(*[F.trim(col(c)).alias(c) if _is_string(df, c) else col(c) for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null or NaN in any column."""
    return df.na.drop("any")


def completeness(df: DataFrame) -> DataFrame:
    """One row (``before``, ``kept``, ``dropped``) for ``drop_incomplete``, from one pass."""
    full = F.lit(True)
    for field in df.schema.fields:
        full = full & col(field.name).isNotNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            full = full & ~F.isnan(col(field.name))
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(full).alias("kept"),
                  F.count_if(~full).alias("dropped"))


def null_sentinel(df: DataFrame, sentinel: str = "?") -> DataFrame:
    """Turn ``sentinel`` into null in every string column."""
    return df.select(*[F.nullif(col(c), F.lit(sentinel)).alias(c) if _is_string(df, c) else col(c)
                       for c in df.columns])


def replace_values(df: DataFrame, values: Mapping[str, int]) -> DataFrame:
    """Replace whole cell values: booleans become 0/1, listed strings their number as text."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, str(v))])
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(field.dataType, T.StringType) and values:
            c = F.coalesce(F.try_element_at(table, c), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def encode_fixed(df: DataFrame, codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Map each named column through its dictionary; values without a code become null."""
    def coded(name: str) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in codes[name].items() for x in (k, v)])
        return F.try_element_at(table, col(name)).alias(name)
    return df.select(*[coded(c) if c in codes else col(c) for c in df.columns])


def learn_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, code)``: each value's 0-based place among its column's sorted values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                                for c in names])).alias("p")
    distinct = df.select(pairs).select("p.*").filter(F.col("value").isNotNull()).distinct()
    return value_rank(distinct, "column", "value", "code")


def apply_codes(df: DataFrame, codes: DataFrame, names: list[str]) -> DataFrame:
    """Replace the named columns by their learned codes; null stays null.

    Short dictionaries become constant maps, so those columns cost no join at all; each of the others
    is one join of the table, which is read once however many there are.
    """
    _require(df, names)
    sizes = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()}
    short = [c for c in names if sizes.get(c, 0) <= INLINE_CODES]
    inline: dict[str, list[Column]] = {c: [] for c in short}
    for r in codes.filter(F.col("column").isin(short)).collect():
        inline[r["column"]] += [F.lit(r["value"]), F.lit(r["code"])]
    out = df
    for i, name in enumerate(names):
        if name in short:
            continue
        mine = codes.filter(F.col("column") == name).select(
            F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(mine, col(name).cast("string") == F.col(f"_value{i}"), "left")

    def coded(name: str) -> Column:
        if name not in short:
            return F.col(f"_code{names.index(name)}").alias(name)
        if not inline[name]:
            return F.lit(None).cast("bigint").alias(name)
        return F.try_element_at(F.create_map(*inline[name]), col(name).cast("string")).alias(name)
    return out.select(*[coded(c) if c in names else col(c) for c in df.columns])


def encode_learned(df: DataFrame, names: list[str]) -> DataFrame:
    """Ordinal codes learned from the table itself, nulls left out."""
    return apply_codes(df, cut_lineage(learn_codes(df, names), "codes"), names)


def categories(df: DataFrame, names: list[str], limit: int | None = None) -> dict[str, list]:
    """Sorted distinct non-null values per column, found in one pass.

    They become columns, so they come to the driver; given ``limit``, more values of one column raise.
    """
    seen = df.agg(*[F.sort_array(F.collect_set(col(c))).alias(f"v{i}") for i, c in enumerate(names)]).first()
    found = {c: list(seen[f"v{i}"]) for i, c in enumerate(names)}
    for name, values in found.items():
        if limit is not None and len(values) > limit:
            raise ValueError(f"column {name!r} has more than {limit} categories")
    return found


def one_hot(df: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """0/1 columns ``<column>_<value>`` at the end, without each column's first value."""
    _require(df, names)
    found = categories(df, names, limit)
    kept = [col(c) for c in df.columns if c not in names]
    added = [F.coalesce((col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
             for c in names for v in found[c][1:]]
    return df.select(*kept, *added)


def one_hot_vector(df: DataFrame, names: list[str], out: str = "one_hot") -> DataFrame:
    """The same as one sparse vector column, for columns of very many categories.

    A column's places follow its learned codes, its first value has none; no value becomes a column.
    """
    codes = cut_lineage(learn_codes(df, names), "codes")
    sizes = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()}
    places, start = [], 0
    coded = apply_codes(df, codes, names)
    for name in names:
        places.append(F.when(col(name) > 0, col(name) - 1 + start))
        start += max(0, sizes.get(name, 0) - 1)
    held = F.array_compact(F.array(*places))
    entries = F.map_from_arrays(held, F.transform(held, lambda _: F.lit(1.0)))
    others = [col(c) for c in df.columns if c not in names]
    return coded.select(*others, F.struct(F.lit(start).cast("bigint").alias("size"), F.map_keys(entries).alias("indices"),
                                          F.map_values(entries).alias("values")).alias(out))


def coerce_numeric(df: DataFrame, keep: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Turn every string column into doubles, unreadable values into null."""
    return df.select(*[to_number(col(c)).alias(c) if _is_string(df, c) and c not in keep else col(c)
                       for c in df.columns])


def strict_bigint(df: DataFrame, keep: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Cast every column to bigint; a value that is no integer fails the job. Fractions of
    numeric columns are cut off."""
    def cast(name: str) -> Column:
        value = col(name).try_cast("bigint")
        bad = F.concat(F.lit(f"column {name}: not an integer: "),
                       F.coalesce(col(name).cast("string"), F.lit("null")))
        return F.when(value.isNull(), F.raise_error(bad)).otherwise(value).alias(name)
    return df.select(*[col(c) if c in keep else cast(c) for c in df.columns])


def features_of(df: DataFrame, target: str, key: str = "idx") -> list[str]:
    """Feature names in table order."""
    _require(df, [target])
    return [c for c in df.columns if c not in (target, key)]


def mask_names(names: list[str], key: str = "idx") -> dict[str, str]:
    """Column name -> ``x<position>``, target included; the row key keeps its name."""
    return {c: f"x{i}" for i, c in enumerate(c for c in names if c != key)}


def mask_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that ``names`` covers."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def mask_importances(importances: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the ``feature`` values of an importance table."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    masked = F.coalesce(F.try_element_at(table, F.col("feature")), F.col("feature"))
    return importances.withColumn("feature", masked)


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the first position of each, in that order."""
    return (df.groupBy(col(value).alias("value")).agg(F.min(col(position)).alias("first_pos"))
            .orderBy("first_pos"))


def zscore(df: DataFrame, names: list[str]) -> DataFrame:
    """Centre and scale columns by their population deviation; constant columns are only centred.

    Two numbers per column come back from one pass and become constants of the next.
    """
    stats = df.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names)
                     for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def scaled(i: int, name: str) -> Column:
        return ((col(name) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)).alias(name)
    place = {c: i for i, c in enumerate(names)}
    return df.select(*[scaled(place[c], c) if c in place else col(c) for c in df.columns])
