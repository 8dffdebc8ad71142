"""Cleaning recipes for the four public tables: titanic, diabetes, loan and mushroom."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.config import Dataset
from tessera.operators import clean

# Codes and column names that decide the encoded tables.
TITANIC_UNUSED = ["PassengerId", "Name", "Ticket", "Cabin"]
TITANIC_CODES = {
    "Sex": {"male": 0, "female": 1},
    "Embarked": {"S": 0, "C": 1, "Q": 2},
}
LOAN_UNUSED = ["loan_id"]
LOAN_ONE_HOT = ["education", "self_employed"]
LOAN_VALUES = {"Approved": 1, "Rejected": 0}
MUSHROOM_TARGET = {"e": 0, "p": 1}
MUSHROOM_CODES = {
    "cap-shape": {"b": 0, "c": 1, "x": 2, "f": 3, "k": 4, "s": 5},
    "cap-surface": {"f": 0, "g": 1, "y": 2, "s": 3},
    "cap-color": {"n": 0, "b": 1, "c": 2, "g": 3, "r": 4, "p": 5, "u": 6, "e": 7, "w": 8, "y": 9},
    "bruises": {"f": 0, "t": 1},
    "odor": {"a": 0, "l": 1, "c": 2, "y": 3, "f": 4, "m": 5, "n": 6, "p": 7, "s": 8},
    "gill-attachment": {"a": 0, "d": 1, "f": 2, "n": 3},
    "gill-spacing": {"c": 0, "w": 1, "d": 2},
    "gill-size": {"b": 0, "n": 1},
    "gill-color": {"k": 0, "n": 1, "b": 2, "h": 3, "g": 4, "r": 5,
                   "o": 6, "p": 7, "u": 8, "e": 9, "w": 10, "y": 11},
    "stalk-shape": {"e": 0, "t": 1},
    "stalk-root": {"b": 0, "c": 1, "u": 2, "e": 3, "z": 4, "r": 5},
    "stalk-surface-above-ring": {"f": 0, "y": 1, "k": 2, "s": 3},
    "stalk-surface-below-ring": {"f": 0, "y": 1, "k": 2, "s": 3},
    "stalk-color-above-ring": {"n": 0, "b": 1, "c": 2, "g": 3, "o": 4, "p": 5, "e": 6, "w": 7, "y": 8},
    "stalk-color-below-ring": {"n": 0, "b": 1, "c": 2, "g": 3, "o": 4, "p": 5, "e": 6, "w": 7, "y": 8},
    "veil-type": {"p": 0, "u": 1},
    "veil-color": {"n": 0, "o": 1, "w": 2, "y": 3},
    "ring-number": {"n": 0, "o": 1, "t": 2},
    "ring-type": {"c": 0, "e": 1, "f": 2, "l": 3, "n": 4, "p": 5, "s": 6, "z": 7},
    "spore-print-color": {"k": 0, "n": 1, "b": 2, "h": 3, "r": 4, "o": 5, "u": 6, "w": 7, "y": 8},
    "population": {"a": 0, "c": 1, "n": 2, "s": 3, "v": 4, "y": 5},
    "habitat": {"g": 0, "l": 1, "m": 2, "p": 3, "u": 4, "w": 5, "d": 6},
}


def titanic(df: DataFrame) -> DataFrame:
    """Drop identifying columns, code sex and port, keep complete numeric rows."""
    kept = clean.drop_columns(df, TITANIC_UNUSED)
    return clean.drop_incomplete(clean.coerce_numeric(clean.encode_fixed(kept, TITANIC_CODES)))


def diabetes(df: DataFrame) -> DataFrame:
    """Keep complete numeric rows."""
    return clean.drop_incomplete(clean.coerce_numeric(df))


def loan(df: DataFrame) -> DataFrame:
    """Drop the id, one-hot the two categories, code the decision, all integers.

    Blanks around column names and cell values are removed first.
    """
    named = clean.trim_values(clean.trim_names(df))
    full = clean.drop_incomplete(clean.drop_columns(named, LOAN_UNUSED, strict=True))
    coded = clean.replace_values(clean.one_hot(full, LOAN_ONE_HOT), LOAN_VALUES)
    return clean.strict_bigint(coded)


def mushroom(df: DataFrame, target: str = "class", key: str = "idx") -> DataFrame:
    """Code every feature by its sorted values, the target and bruises by fixed codes."""
    known = clean.null_sentinel(df)
    fixed = {c: m for c, m in ((target, MUSHROOM_TARGET), ("bruises", MUSHROOM_CODES["bruises"]))
             if c in df.columns}
    learned = [c for c in df.columns if c not in fixed and c != key]
    coded = clean.encode_learned(clean.encode_fixed(known, fixed), learned)
    return clean.drop_incomplete(clean.coerce_numeric(coded))


def mushroom_fixed(df: DataFrame, target: str = "class") -> DataFrame:
    """Code every feature through the published letter tables."""
    codes = {c: m for c, m in MUSHROOM_CODES.items() if c in df.columns}
    codes[target] = MUSHROOM_TARGET
    coded = clean.encode_fixed(clean.null_sentinel(df), codes)
    return clean.drop_incomplete(clean.coerce_numeric(coded))


TITANIC = Dataset("titanic", "Survived", {0: "Did not survive", 1: "Survived"}, titanic)
DIABETES = Dataset("diabetes", "Outcome", {0: "No", 1: "Yes"}, diabetes)
LOAN = Dataset("loan", "loan_status", {0: "Not Approved", 1: "Approved"}, loan)
MUSHROOM = Dataset("mushroom", "class", {0: "Edible", 1: "Poisonous"}, mushroom)
