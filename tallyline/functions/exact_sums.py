"""Sums of floating-point numbers that do not depend on the order of addition.

A double is a whole number of at most 53 bits times a power of two. Its bits are cut at fixed powers of two into
*parts* of 24 bits, each a small whole number. Parts are summed as whole numbers, which is exact in any order and under any
grouping, and can be subtracted again. Only the final sums are put together, rounded once to the nearest double. So equal
amounts have equal sums, whichever way the rows came.

Which parts a column needs follows from its largest and smallest values. Numbers of other types are summed as they are and
are their own single part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import FLOAT_TYPES, type_of

BITS = 24
"""Bits of a part. Half a trillion of them can be added up in a long."""
_BASE = 1 << BITS
_FEW = 4
"""Parts of up to 50 bits that fit together in 38 digits."""
# A double's lowest bit, and the bits of its mantissa.
LOWEST_BIT, MANTISSA = -1074, 53
SPECIAL = ("nan", "inf", "neginf")
_PART = re.compile(r"(.*)__(?:([mp])(\d+)|nan|inf|neginf)")


def _scaled(value: Column, power: int) -> Column:
    """``value`` times a power of two, in two steps where one factor would not be a double."""
    half = power // 2
    return value * F.lit(2.0**half) * F.lit(2.0 ** (power - half))


def _number(part: str) -> int:
    sign, digits = _PART.fullmatch(part).groups()[1:]
    return -int(digits) if sign == "m" else int(digits)


def _name(column: str, number: int) -> str:
    return f"{column}__{'m' if number < 0 else 'p'}{abs(number)}"


def part_names(columns: list[str], column: str) -> list[str]:
    """The parts of ``column`` among the given names, lowest first and the counts of special values last; itself if it has none."""
    mine = [name for name in columns if (found := _PART.fullmatch(name)) and found[1] == column]
    numbers = sorted((name for name in mine if not name.endswith(SPECIAL)), key=_number)
    return numbers + [name for end in SPECIAL for name in mine if name == f"{column}__{end}"] or [column]


def split(df: DataFrame, column: str) -> list[Column]:
    """The parts of a column without nulls, named after it. For floating-point columns the table is read once, for the range of its values."""
    value = F.col(column)
    if not isinstance(type_of(df, column), FLOAT_TYPES):
        return [value.alias(column)]
    value = value.cast("double")
    size = F.abs(value)
    finite = size < float("inf")
    least, greatest, special = df.agg(
        F.min(F.when(finite & (size > 0), size)), F.max(F.when(finite, size)), F.count_if(~finite | F.isnan(value))
    ).first()
    if not least:
        first = last = 0
    else:
        first = max(math.frexp(least)[1] - MANTISSA, LOWEST_BIT) // BITS
        last = (math.frexp(greatest)[1] - 1) // BITS
    number = F.when(finite, value).otherwise(0.0) if special else value
    parts = []
    for i in range(first, last + 1):
        # What lies below the part's upper end, cut off below its lower one. Both steps are exact.
        below = number % F.lit(2.0 ** (BITS * (i + 1))) if i < last else number
        parts.append(_scaled(below, -BITS * i).cast("bigint").alias(_name(column, i)))
    if special:
        tests = (F.isnan(value), value == float("inf"), value == float("-inf"))
        parts += [F.when(test, 1).otherwise(0).cast("bigint").alias(f"{column}__{end}") for test, end in zip(tests, SPECIAL)]
    return parts


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _carried(sums: Column) -> Column:
    """``carry`` and ``digits`` of part sums: the same number with every digit between 0 and the base, lowest first."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def add(done: Column, part: Column) -> Column:
        total = done["carry"] + part
        return F.struct(
            F.shiftright(total, BITS).alias("carry"),
            F.concat(done["digits"], F.array(total.bitwiseAND(F.lit(_BASE - 1).cast("bigint")))).alias("digits"),
        )

    return F.aggregate(sums, nothing, add)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _nearest(digits: Column, first: int) -> Column:
    """The double nearest to the number with these digits, highest first, of which the last but three is part ``first``.

    The three digits below that are 0.
    """

    def from_top(place: Column) -> Column:
        digit = [F.element_at(digits, (place + i).cast("int")) for i in range(4)]
        rest = F.exists(F.slice(digits, (place + 4).cast("int"), F.size(digits)), lambda d: d != 0)
        highs_and_lows = F.array(digit[0] * _BASE + digit[1], digit[2] * _BASE + digit[3], F.length(F.bin(digit[0])).cast("bigint"), place)

        def rounded(found: Column) -> Column:
            # 60 bits from the highest one on, of which the lowest also tells whether any bit follows: one rounding is left.
            high, low, length, at = (F.element_at(found, i) for i in range(1, 5))
            taken = _shift("shiftleft", high, 36 - length) + _shift("shiftright", low, 12 + length)
            cut = low.bitwiseAND(_shift("shiftleft", F.lit(1).cast("bigint"), 12 + length) - 1) != 0
            whole = taken.bitwiseOR(F.when(cut | rest, 1).otherwise(0).cast("bigint"))
            power = BITS * (F.lit(first - 4) + F.size(digits) - at) - 36 + length
            half = F.floor(power / 2)
            return whole.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)

        return _bound(highs_and_lows, rounded)

    place = F.array_position(F.transform(digits, lambda d: d != 0), True)
    return _bound(place, lambda at: F.when(at == 0, F.lit(0.0)).otherwise(from_top(at)))


def merge(parts: list[str]) -> Column:
    """The sum that these summed parts stand for: rounded once to the nearest double, or the single part itself."""
    finite = [name for name in parts if not name.endswith(SPECIAL)]
    if not _PART.fullmatch(parts[0]):
        return F.col(parts[0])
    # Room for what the highest part carries over.
    none = F.lit(0).cast("bigint")
    sums = F.array(*[F.col(name) for name in finite], *[none] * 3)
    first = _number(finite[0])

    def digits(of: Column) -> Column:
        return F.concat(F.reverse(_carried(of)["digits"]), F.array(*[none] * 3))

    def signed(all_: Column) -> Column:
        minus = F.transform(all_, lambda s: -s)
        return F.when(_carried(all_)["carry"] < 0, -_bound(digits(minus), lambda d: _nearest(d, first))).otherwise(
            _bound(digits(all_), lambda d: _nearest(d, first))
        )

    result = _bound(sums, signed)
    if len(finite) <= _FEW:
        # Few parts of ordinary size make a whole number that a decimal holds; its cast rounds once as well, and is much quicker.
        whole = sum((F.col(name).cast("decimal(20,0)") * F.lit(Decimal(1 << BITS * i)) for i, name in enumerate(finite[1:], 1)), F.col(finite[0]).cast("decimal(20,0)"))
        small = reduce(lambda a, b: a & b, [F.abs(name) < 1 << 50 for name in finite])
        result = F.when(small, _scaled(whole.cast("double"), BITS * first)).otherwise(result)
    if len(finite) == len(parts):
        return result
    nan, positive, negative = (F.col(name) > 0 for name in parts[len(finite) :])
    return (
        F.when(nan | (positive & negative), F.lit(float("nan")))
        .when(positive, F.lit(float("inf")))
        .when(negative, F.lit(float("-inf")))
        .otherwise(result)
    )


def exact_sum(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The sum of ``column`` per key, as ``column``. Null counts as nothing; a key of nulls alone has the sum 0."""
    kind = type_of(df, column)
    filled = df.withColumn(column, F.coalesce(column, F.lit(0).cast(kind)))
    rows = filled.select(*keys, *split(filled, column))
    names = part_names([name for name in rows.columns if name not in keys], column)
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in names]).select(*keys, merge(names).alias(column))
