"""Order-independent sums of doubles, against the correctly rounded sum of Python."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyline.functions.exact_sums import exact_sum, merge, part_names, split


def sums(spark, groups: list[list[float]], partitions: int = 3, kind: str = "double") -> list:
    rows = [(i, v) for i, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, f"k int, v {kind}").repartition(partitions)
    found = {r.k: r.v for r in exact_sum(df, "v", "k").collect()}
    return [found[i] for i in range(len(groups))]


def rounded_once(values: list[float]) -> float:
    return float(sum(map(Fraction, values), Fraction(0)))


def same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


HALF_ULP = 2.0**-53
CASES = [
    [0.1, 0.2, 0.3],
    [0.3, 0.2, 0.1],
    [0.0],
    [-0.0, -0.0],
    [1.0, HALF_ULP],
    [1.0, HALF_ULP, 2.0**-200],
    [1.0, -(HALF_ULP / 2)],
    [1.0 + 2.0**-52, HALF_ULP],
    [1e308, 1e308, -1e308],
    [1e16, 1.0, -1e16],
    [5e-324] * 7,
    [-5e-324, 2.5e-308, 1e300, -1e300],
    [2.0**1023, 2.0**1023 - 2.0**970, -(2.0**1023)],
    [1.7976931348623157e308],
    [-1.0, 2.0**-1074],
    [3.0, -3.0],
    [1e23, 1.0, 1e-23],
    [-0.1] * 10,
    [2.0**24 - 1, 2.0**24, 1.0, 2.0**48, -(2.0**47)],
]


def test_sums_are_rounded_once(spark):
    found = sums(spark, CASES)
    for case, total in zip(CASES, found):
        assert total == rounded_once(case), case
        assert math.copysign(1, total) == (1 if total == 0 else math.copysign(1, rounded_once(case)))


def test_overflow_and_special_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = [[1e308] * 3, [nan, 1.0], [inf, 1.0], [-inf, 1.0], [inf, -inf], [0.1, 0.2, 0.3], [-1e308] * 4]
    expected = [inf, nan, inf, -inf, nan, 0.6, -inf]
    assert all(same(a, b) for a, b in zip(sums(spark, groups), expected))


@pytest.mark.parametrize("spread", [3, 1000])
def test_random_sums(spark, spread):
    rng = random.Random(spread)
    groups = [
        [rng.choice([-1, 1, 1]) * rng.random() * 2.0 ** rng.randint(-spread, min(spread, 900)) for _ in range(rng.randint(1, 40))]
        for _ in range(150)
    ]
    assert sums(spark, groups, 1) == sums(spark, groups, 7) == [rounded_once(values) for values in groups]


def test_few_parts_and_very_large_sums(spark):
    """What a decimal can hold is summed in one, the rest digit by digit; both are rounded once."""
    rng = random.Random(9)
    groups = [[rng.uniform(0.01, 500) * rng.choice([1, -1]) for _ in range(rng.randint(1, 60))] for _ in range(300)]
    groups += [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [255.99999999999997, 2.0**-45], [-0.1, 0.1]]
    assert sums(spark, groups) == [rounded_once(values) for values in groups]
    parts = spark.sql("select 1 k, cast(pow(2, 62) as bigint) + 1 v__m1, cast(-pow(2, 61) as bigint) + 3 v__p0")
    total = Fraction(2**62 + 1, 2**24) + (-(2**61) + 3)
    assert parts.select(merge(["v__m1", "v__p0"]).alias("v")).first().v == float(total)


def test_other_types_are_summed_as_they_are(spark):
    df = spark.sql("select * from values (1, 2.50, 3L), (1, 0.25, null), (2, null, null) t(k, d, n)")
    assert {r.k: str(r.d) for r in exact_sum(df, "d", "k").collect()} == {1: "2.75", 2: "0.00"}
    assert {r.k: r.n for r in exact_sum(df, "n", "k").collect()} == {1: 3, 2: 0}
    floats = spark.sql("select cast(v as float) v from values (0.1), (0.2) t(v)")
    assert exact_sum(floats, "v").first().v == rounded_once([float.fromhex("0x1.99999ap-4"), float.fromhex("0x1.99999ap-3")])


def test_parts_can_be_subtracted_again(spark):
    df = spark.createDataFrame([(0.1,), (0.7,), (1e10,)], "v double")
    rows = df.select(*split(df, "v"))
    names = part_names(rows.columns, "v")
    total = rows.agg(*[F.sum(name).alias(name) for name in names])
    gone = df.filter("v > 1").select(*[part for part in split(df, "v")])
    left = total.crossJoin(gone.toDF(*[f"gone{i}" for i in range(len(names))])).select(
        *[(F.col(name) - F.col(f"gone{i}")).alias(name) for i, name in enumerate(names)]
    )
    assert left.select(merge(names).alias("v")).first().v == rounded_once([0.1, 0.7])


def test_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0)], "k int, v double")
    assert {r.k: r.v for r in exact_sum(df, "v", "k").collect()} == {1: 0.0, 2: 0.0}
    assert exact_sum(df.limit(0), "v", "k").collect() == []
