"""Hyperparameter trials: sampling from a sweep space and cleaning parameter maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import SEED
from tessera.functions.hashing import uniform
from tessera.functions.text import to_number

# Parameters that are integers whatever their text looks like.
INT_PARAMS = ["n_estimators", "max_depth", "min_child_weight", "random_state", "num_boost_round"]


def draw(name: str, spec: dict, trial: Column, seed: int = SEED) -> Column:
    """One parameter of a trial from its distribution; depends on seed, name and trial only."""
    if spec.get("value") is not None:
        return F.lit(spec["value"])
    u = uniform(seed, F.lit(name), trial)
    if spec.get("values"):
        choices = F.array(*[F.lit(v) for v in spec["values"]])
        return F.get(choices, F.floor(u * len(spec["values"])).cast("int"))
    low, high = spec["min"], spec["max"]
    kind = spec.get("distribution")
    if kind == "log_uniform_values":
        return F.exp(u * (math.log(high) - math.log(low)) + math.log(low))
    if kind == "int_uniform":
        return (F.floor(u * (int(high) - int(low) + 1)) + int(low)).cast("int")
    if kind == "uniform":
        return u * (high - low) + low
    raise ValueError(f"parameter {name!r}: unknown distribution {kind!r}")


def sample_trials(trials: DataFrame, space: dict[str, dict], key: str = "trial",
                  seed: int = SEED) -> DataFrame:
    """``key`` and one column per parameter of ``space`` for every trial row."""
    return trials.select(key, *[draw(n, s, F.col(key), seed).alias(n) for n, s in space.items()])


def clean_params(df: DataFrame, params: str = "params") -> DataFrame:
    """Clean a ``map<string,string>`` of logged parameters.

    Private keys and ``wandb`` go, ``{"value": v}`` gives v, integer parameters lose their
    fraction, digit runs stay as they are and other numbers take the double's text.
    """
    def keep(k: Column, _: Column) -> Column:
        return ~k.startswith("_") & (k != "wandb")

    def clean(k: Column, v: Column) -> Column:
        inner = F.when(v.rlike(r"^\s*\{"), F.get_json_object(v, "$.value"))
        plain = F.coalesce(inner, v)
        number = to_number(plain)
        whole = F.when(k.isin(INT_PARAMS), number.try_cast("bigint").cast("string"))
        typed = F.when(plain.rlike(r"^\d+$"), plain.try_cast("bigint").cast("string"))
        return F.coalesce(whole, typed, number.cast("string"), plain)
    return df.withColumn(params, F.transform_values(F.map_filter(params, keep), clean))


def typed_params(df: DataFrame, types: dict[str, str], params: str = "params") -> DataFrame:
    """Spread a cleaned parameter map into columns of the given types."""
    others = [c for c in df.columns if c != params]
    return df.select(*others, *[F.try_element_at(params, F.lit(n)).try_cast(t).alias(n)
                                for n, t in types.items()])
