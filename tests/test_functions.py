import math

import pytest
from pyspark.sql import functions as F

from revscope.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("v", "want"), [(2.345, 2.35), (-2.5, -2.5), (0.125, 0.13), (-0.125, -0.12)])
def test_halves_go_up(spark, v, want):
    assert one(spark, S.half_up(F.lit(v))) == want


@pytest.mark.parametrize(("text", "want"), [("12", 12.0), (" 1.5e2 ", 150.0), (".5", 0.5), ("12d", None), ("0x10", None), ("Infinity", None), ("NaN", None), ("", None), ("1,5", None), ("1e999", None)])
def test_only_decimal_literals_are_numbers(spark, text, want):
    assert one(spark, S.number(F.lit(text))) == want


def test_two_medians(spark):
    four = F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0]))
    assert one(spark, S.upper_median(four)) == 3.0 and one(spark, S.true_median(four)) == 2.5
    assert one(spark, S.upper_median(F.array().cast("array<double>"))) is None


@pytest.mark.parametrize(("ratio", "gear"), [(136.0, 1), (72.0, 2), (44.5, 3), (31.0, 4), (110.0, 1), (98.0, None), (200.0, None), (10.0, None), (56.0, 3), (57.0, None), (20.0, None)])
def test_nearest_gear_bands(spark, ratio, gear):
    assert one(spark, S.nearest_gear(F.lit(ratio))) == gear


def test_region_order(spark):
    def region(rpm, tps, map_, ptps=50.0, pmap=50.0):
        return one(spark, S.region(*(F.lit(v).cast("double") for v in (rpm, tps, map_, ptps, pmap))))

    assert region(None, 99.0, 90.0) == "cruise"
    assert region(2000.0, 60.0, 50.0) == "transient"
    assert region(2000.0, 78.0, 50.0, 78.0) == "wot"
    assert region(800.0, 1.0, 40.0, 1.0, 40.0) == "idle"
    assert region(800.0, None, None, None, None) == "idle"
    assert region(1100.0, 1.0, 40.0, 1.0, 40.0) == "cruise"


@pytest.mark.parametrize(("equation", "factor"), [("X", 1.0), ("X/10", 10.0), ("X*0.5", 2.0), ("X * (90/255)", 255 / 90), ("X+1", None), ("LOG(X)", None), ("X/0", None)])
def test_linear_equations(spark, equation, factor):
    got = one(spark, S.raw_per_unit(F.lit(equation)))
    assert got == factor or math.isclose(got, factor)


def test_lambda_and_trims(spark):
    assert [one(spark, S.as_lambda(F.lit(v))) for v in (14.7, 0.9, 3.0, 0.2)] == [1.0, 0.9, None, None]
    assert one(spark, S.trim_percent(F.lit(134.4), F.lit("count128"))) == pytest.approx(5.0)
    assert one(spark, S.trim_percent(F.lit(1.05), F.lit("multiplier"))) == pytest.approx(5.0)
    assert one(spark, S.trim_percent(F.lit(None).cast("double"), F.lit("percent"))) == 0.0


def test_axis_places(spark):
    axis = F.array(*map(F.lit, [0.0, 10.0, 20.0]))
    assert [one(spark, S.axis_coordinate(axis, F.lit(v))) for v in (-5.0, 0.0, 5.0, 20.0, 99.0)] == [0.0, 0.0, 0.5, 2.0, 2.0]
    assert [one(spark, S.nearest_place(axis, F.lit(v))) for v in (5.0, 5.1, -9.0)] == [0, 1, 0]


def test_atmosphere(spark):
    assert one(spark, S.half_up(S.baro_for_altitude(F.lit(0.0)), 1)) == 101.3
    assert one(spark, S.half_up(S.baro_for_altitude(F.lit(5000.0)), 1)) == 84.3
