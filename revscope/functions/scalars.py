"""Scalar rules of the domain as Column expressions. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of knock retard for one raw count, km/h to mph, stoichiometric AFR.
KR_RAW_TO_DEG = 0.175781
KPH_TO_MPH = 0.621371
STOICH_AFR = 14.7
#: Engine speed over road speed in each gear, and how far off a ratio may be.
GEAR_CENTERS = [136.0, 72.0, 44.5, 31.0]
GEAR_TOLERANCE = 0.28


def half_up(x: Column, places: int = 2) -> Column:
    """Round halves toward +infinity (Spark's ``round`` goes away from zero)."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_up_int(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def clean(x: Column) -> Column:
    """NaN and infinities are missing."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A finite decimal literal as a double, anything else NULL (Spark's own cast takes '12d' and 'Infinity')."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), clean(t.try_cast("double")))


def binned(x: Column, width: float) -> Column:
    """Lower edge of the half-open bin of x."""
    return (F.floor(x / F.lit(float(width))) * F.lit(float(width))).cast("long")


def bin_label(low: Column, width: int) -> Column:
    return F.concat_ws("-", low.cast("string"), (low + F.lit(width)).cast("string"))


def trim_percent(v: Column, style: Column) -> Column:
    """A fuel trim in percent; a missing trim counts as 0."""
    pct = F.when(style == "multiplier", (v - 1) * 100).when(style == "count128", (v - 128) / 128 * 100).otherwise(v)
    return F.coalesce(pct, F.lit(0.0))


def trim_style(middle: Column) -> Column:
    """Encoding of a trim channel, from the upper median of its first values."""
    return F.when((middle > 0.5) & (middle < 1.5), "multiplier").when((middle >= 90) & (middle <= 170), "count128").otherwise("percent")


def trim_counts(v: Column, style: Column) -> Column:
    """A trim on the scale where 128 is neutral; missing stays missing."""
    return F.when(style == "multiplier", v * 128).when(style == "percent", 128 + v * 1.28).otherwise(v)


def as_lambda(v: Column) -> Column:
    return F.when(v > 5, v / STOICH_AFR).when((v > 0.3) & (v < 2.5), v)


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of a collected array; NULL when empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def true_median(values: Column) -> Column:
    """Mean of the two middle values."""
    s, n = F.array_sort(values), F.size(values)
    upper, lower = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int")), F.try_element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    return (upper + lower) / 2


def mean_from_last(v: Column, at: Column) -> Column:
    """Mean of a group's doubles, summed from the last place to the first.

    Sums of hundredths are inexact, so their order decides how a mean that ends in a half is
    rounded. The comparison SQL, whose plan meets the rows of a log in this order, leaves it open.
    """
    values = F.collect_list(F.when(v.isNotNull(), F.struct(at.alias("at"), v.cast("double").alias("v"))))
    total = F.aggregate(F.reverse(F.array_sort(values)), F.lit(0.0), lambda a, x: a + x["v"])
    return F.try_divide(total, F.size(values))


def region(rpm: Column, tps: Column, map_: Column, prev_tps: Column, prev_map: Column) -> Column:
    """Operating region of a row, given the row before it."""
    jump = F.coalesce(F.abs(tps - prev_tps) >= 8, F.lit(False)) | F.coalesce(F.abs(map_ - prev_map) >= 8, F.lit(False))
    idle = (rpm < 1100) & (tps.isNull() | (tps < 5)) & (map_.isNull() | (map_ < 50))
    return F.when(rpm.isNull(), "cruise").when(jump, "transient").when(tps >= 78, "wot").when(idle, "idle").otherwise("cruise")


def segment(rpm: Column, tps: Column, vss: Column) -> Column:
    """Drive segment of a row (a vocabulary of its own, apart from the regions)."""
    missing = rpm.isNull() | tps.isNull() | vss.isNull()
    return (
        F.when(missing, "other")
        .when((rpm < 1450) & (tps < 2) & (vss < 3), "idle")
        .when(tps > 70, "wot")
        .when((tps < 2) & (rpm > 1500) & (vss > 10), "decel")
        .when((vss > 3) & (tps >= 2) & (tps <= 70), "cruise")
        .otherwise("other")
    )


def is_idle(rpm: Column, tps: Column, vss: Column) -> Column:
    return F.coalesce((rpm < 1450) & (tps.isNull() | (tps < 2)) & (vss.isNull() | (vss < 3)), F.lit(False))


def warm_threshold(max_ect: Column) -> Column:
    return F.when(max_ect > 140, 160.0).otherwise(max_ect - 10)


def gear_ratio(rpm: Column, mph: Column, vss: Column) -> Column:
    return F.when((vss >= 2) & (rpm >= 400), rpm / mph)


def nearest_gear(ratio: Column) -> Column:
    """Gear whose center is nearest, the lower on ties; NULL outside every band."""
    off = F.array(*(F.struct(F.abs(ratio - c).alias("d"), F.lit(g + 1).alias("g"), F.lit(c).alias("c")) for g, c in enumerate(GEAR_CENTERS)))
    best = F.array_min(off)
    return F.when((ratio >= 12) & (ratio <= 220) & (best["d"] <= best["c"] * GEAR_TOLERANCE), best["g"])


def baro_for_altitude(feet: Column) -> Column:
    """Standard atmosphere in kPa at an altitude, sea level at least."""
    metres = F.greatest(feet * 0.3048, F.lit(0.0))
    return F.lit(101.325) * F.pow(1 - F.lit(2.25577e-5) * metres, F.lit(5.25588))


def nearest_place(axis: Column, v: Column) -> Column:
    """Index of the breakpoint nearest to v, the first on ties."""
    return F.array_min(F.transform(axis, lambda b, i: F.struct(F.abs(b - v).alias("d"), i.alias("i"))))["i"]


def axis_coordinate(axis: Column, v: Column) -> Column:
    """Fractional index of v on a rising axis, held at its ends."""
    last = F.size(axis) - 1
    left = F.least(F.greatest(F.size(F.filter(axis, lambda b: b <= v)) - 1, F.lit(0)), F.greatest(last - 1, F.lit(0)))
    a, b = F.try_element_at(axis, (left + 1).cast("int")), F.try_element_at(axis, (left + 2).cast("int"))
    inside = F.when(b.isNull() | (b == a), F.lit(0.0)).otherwise((v - a) / (b - a))
    return F.least(F.greatest(left + inside, F.lit(0.0)), last.cast("double"))


def breakpoints(labels: Column) -> Column:
    """Axis labels as finite numbers; others go."""
    return F.filter(F.transform(labels, number), lambda x: x.isNotNull())


def normalized_header(name: Column) -> Column:
    lowered = F.regexp_replace(F.lower(name), r"[_\-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[()\[\]%]", ""), r"\s+", " "))


def raw_per_unit(equation: Column) -> Column:
    """Raw counts for one unit of a linear equation ``X``, ``X*a``, ``X/a`` or ``X*(a/b)``; NULL refuses any other."""
    e = F.regexp_replace(F.upper(equation), r"\s+", "")
    n = r"(\d+\.?\d*|\.\d+)"

    def part(pattern: str, k: int) -> Column:
        return number(F.regexp_extract(e, pattern, k))

    times, over, both = rf"^X\*{n}$", rf"^X/{n}$", rf"^X\*\({n}/{n}\)$"
    factor = F.when(e == "X", 1.0).when(e.rlike(times), part(times, 1)).when(e.rlike(over), F.try_divide(F.lit(1.0), part(over, 1))).when(e.rlike(both), F.try_divide(part(both, 1), part(both, 2)))
    return F.try_divide(F.lit(1.0), factor)


def decoded(raw: Column, equation: Column) -> Column:
    """A raw element in the units of its equation."""
    return F.try_divide(raw.cast("double"), raw_per_unit(equation))


def trim_color(trim: Column) -> Column:
    """Diverging ramp: -1 at -10 % and below, 0 at 0, 1 at +10 % and above."""
    return F.least(F.greatest(trim / 10, F.lit(-1.0)), F.lit(1.0))


def engine_pitch(rpm: Column) -> Column:
    """Firing frequency of a six-cylinder engine in Hz."""
    return F.coalesce(rpm, F.lit(0.0)) / 60 * 3


def engine_cutoff(rpm01: Column, load01: Column) -> Column:
    return 400 + 800 * (0.6 * F.pow(rpm01, F.lit(1.25)) + 0.4 * load01)


def load_words(kpa: Column) -> Column:
    return F.when(kpa < 40, "light load").when(kpa < 70, "medium load").when(kpa < 90, "heavy load").otherwise("full load")


def rpm_words(rpm: Column) -> Column:
    return F.when(rpm < 1200, "idle speed").when(rpm < 2500, "low rpm").when(rpm < 4000, "mid rpm").otherwise("high rpm")
