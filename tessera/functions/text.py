"""String expressions used by the response parsers and row encoders."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\x1c-\x1f]"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*([+-]?inf(inity)?|nan)\s*$"
_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def strip(text: Column) -> Column:
    """Remove white space (Unicode too) at both ends."""
    left = F.regexp_replace(text, f"(?U)^{_BLANK}+", "")
    return F.regexp_replace(left, f"(?U)(?<!{_BLANK}){_BLANK}++\\z", "")


def second_piece(text: Column, marker: str) -> Column:
    """The piece between the first and second ``marker``; null when there is no marker."""
    return F.get(F.split(text, f"\\Q{marker}\\E", 3), 1)


def after_last(text: Column, marker: str) -> Column:
    """The text after the last ``marker``; the whole text when there is none."""
    return F.substring_index(text, marker, -1)


def first_int(text: Column, too_long: Column | None = None) -> Column:
    """The first run of ASCII digits as a bigint, -1 without one.

    Runs too long for a bigint become ``too_long`` or, without it, numbers from 2^62 on by a hash of their
    digits, so that different ones stay different labels. The run is searched once: it is an element of its own.
    """
    def value(digits: Column) -> Column:
        hashed = F.pmod(F.xxhash64(F.ltrim(digits, F.lit("0"))), F.lit(2**62)) + F.lit(2**62)
        long = hashed if too_long is None else too_long
        return F.when(digits.isNull(), F.lit(-1).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), long))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(F.regexp_substr(text, F.lit("[0-9]+"))), value), F.lit(0)))


def strict_object(text: Column, schema: str) -> Column:
    """Parse ``text`` as exactly one JSON object, else null.

    The JSON reader ignores whatever follows a value. Text that parses both as the only
    element of an array and as the only member of an object has nothing after it.
    """
    options = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{schema}>", options)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{schema}>", options)
    return F.when((F.size(listed) == 1) & member["v"].isNotNull(), listed[0])


def to_number(value: Column) -> Column:
    """Text as a double, null where it is not a plain decimal number."""
    numeric = value.rlike(_NUMBER) | value.rlike(_SPECIAL)
    return F.when(numeric, F.trim(value).try_cast("double"))


def plain_number(value: Column) -> Column:
    """A double as decimal text: no exponent, no trailing zeros, no negative zero.

    The digits are those of the shortest text that reads back as the same double, at every magnitude:
    an exponent moves the point.
    """
    size = F.abs(value)

    def placed(text: Column) -> Column:
        mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
        whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        digits, point = F.concat(whole, part), F.length(whole) + power
        return (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                .when(point >= F.length(digits), F.rpad(digits, point, "0"))
                .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."),
                                    F.substring(digits, point + 1, F.length(digits)))))

    # Only the rare texts with an exponent are taken apart, each once as an element of its own.
    moved = F.get(F.transform(F.array(size.cast("string")), placed), F.lit(0))
    moved = F.when(moved.contains("."), F.regexp_replace(moved, r"\.?0+$", "")).otherwise(moved)
    return (F.when((value == F.rint(value)) & (size < 1e15), value.cast("bigint").cast("string"))
            .when((size >= 1e-3) & (size < 1e7), value.cast("string"))
            .when(size < float("inf"), F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), moved))
            .otherwise(F.lit("null")))


def plain_string(value: Column) -> Column:
    """Text as is when it cannot be mistaken for anything else, else in JSON quotes."""
    safe = (value.rlike(r"^[\p{L}_][\p{L}\p{N}_ ./()+-]*$") & ~value.rlike(r"\s$")
            & ~value.isin("true", "false", "null"))
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).when(safe, value).otherwise(quoted)


def plain_value(value: Column, dtype: T.DataType) -> Column:
    """One value as text, by type."""
    if isinstance(dtype, T.StringType):
        return plain_string(value)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return plain_number(value)
    return F.coalesce(value.cast("string"), F.lit("null"))


def plain_key(name: str) -> str:
    """A column name as a key, in JSON quotes unless it is an identifier."""
    return name if _PLAIN_KEY.fullmatch(name) else json.dumps(name, ensure_ascii=False)


def fill(template: str, slots: dict[str, Column]) -> Column:
    """Replace each ``{slot}`` of ``template`` with a column; other braces stay."""
    pieces = re.split(r"\{(" + "|".join(map(re.escape, slots)) + r")\}", template)
    columns = [slots[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p]
    return F.concat(*columns)
