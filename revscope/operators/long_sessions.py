"""Sessions too long for one task: logs merged into one, cut into chunks of rows.

A session's rows are numbered from 0 without gaps (``merge.merged`` does that), and a
chunk is ``size`` of them. No step holds more of a session than a chunk of rows, or one
row for each chunk:

* what reaches a few rows back or ahead is a window over a chunk with a halo, the
  neighbours' nearest rows, which are dropped afterwards;
* running counts, the last known value and figures of the whole session are taken in
  each chunk, combined over the chunks, and joined back by chunk, so that no join has
  the session as its key;
* a state machine is first a function: each chunk tells for every state in which it
  may be entered the state in which it is left. The functions are applied one after
  the other to the initial state, one row for a chunk, and each chunk then runs from the
  state that it is entered in.

Results are those of the same rules over the whole log, whatever the size of a chunk.
"""

from __future__ import annotations

from collections.abc import Hashable
from itertools import product
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from revscope.cluster import ship_package, staged
from revscope.functions import scalars as S
from revscope.operators import features as X
from revscope.operators import folds, order

CHUNK = 8192
KEY = ["log_id", "chunk"]


def IN_CHUNK() -> WindowSpec:  # noqa: N802 - windows need a session, so they are made when asked for
    return Window.partitionBy(*KEY).orderBy("row_idx")


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("row_idx") / size))


def with_halo(rows: DataFrame, before: int, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Chunks with the last rows of the chunk before and the first of the one behind; those are marked ``halo``."""
    if max(before, after) > size:
        raise ValueError(f"a chunk of {size} rows is shorter than a reach of {max(before, after)}")
    chunk, at = F.floor(F.col("row_idx") / size), F.pmod("row_idx", F.lit(size))
    place = lambda c, halo: F.struct(c.alias("chunk"), F.lit(halo).alias("halo"))
    copies = F.array_compact(F.array(place(chunk, False), F.when(at >= size - before, place(chunk + 1, True)), F.when((at < after) & (chunk > 0), place(chunk - 1, True))))
    return rows.drop("chunk").withColumn("_copy", F.explode(copies)).withColumns({"chunk": F.col("_copy.chunk"), "halo": F.col("_copy.halo")}).drop("_copy")


def without_halo(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("halo")).drop("halo")


def with_session_values(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add aggregates of the whole session to its rows, by way of its chunks."""
    whole = rows.groupBy("log_id").agg(*(v.alias(name) for name, v in values.items()))
    return rows.join(rows.select(*KEY).distinct().join(whole, "log_id"), KEY)


def with_counts(rows: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """Add running counts over the session, up to and with each row."""
    rows = rows.withColumns({f"_hit_{name}": F.coalesce(h.cast("boolean"), F.lit(False)).cast("long") for name, h in hits.items()})
    earlier = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*KEY).agg(*(F.sum(f"_hit_{name}").alias(name) for name in hits))
    offsets = totals.select(*KEY, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in hits))
    inside = IN_CHUNK().rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({name: F.sum(f"_hit_{name}").over(inside) for name in hits}).join(offsets, KEY)
    return joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in hits}).drop(*(f"_{x}_{name}" for name in hits for x in ("hit", "before")))


def with_last(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the last value that is not null, at or before each row of the session."""
    rows = rows.withColumns({f"_of_{name}": v for name, v in values.items()})
    earlier = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(*KEY).agg(*(F.max_by(f"_of_{name}", F.when(F.col(f"_of_{name}").isNotNull(), F.col("row_idx"))).alias(name) for name in values))
    carried = lasts.select(*KEY, *(F.last(name, ignorenulls=True).over(earlier).alias(f"_before_{name}") for name in values))
    inside = IN_CHUNK().rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({name: F.last(f"_of_{name}", ignorenulls=True).over(inside) for name in values}).join(carried, KEY)
    return joined.withColumns({name: F.coalesce(name, f"_before_{name}") for name in values}).drop(*(f"_{x}_{name}" for name in values for x in ("of", "before")))


def upper_medians(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(log_id, name): the upper median of each session's values, found by place in their global order."""
    values = rows.select("log_id", value.alias("v")).where("v is not null").withColumn("one", F.lit(1).cast("long"))
    placed = staged(order.with_running_sums(values, ["log_id", "v"], {"nth": "one"}), "placed")
    spans = placed.groupBy("log_id").agg((F.min("nth") + F.floor(F.count("*") / 2)).alias("nth"))
    return placed.join(F.broadcast(spans) if spans.limit(1001).count() <= 1000 else spans, ["log_id", "nth"]).select("log_id", F.col("v").alias(name))


def with_features(session: DataFrame, size: int = CHUNK) -> DataFrame:
    """The features of ``features.with_features``, chunk by chunk."""
    rpm, tps, map_, vss, ect = (X.channel(session, c) for c in ("rpm", "tps", "map", "vss", "ect"))
    near = with_halo(session, 1, size=size).withColumns({"prev_tps": F.lag(tps).over(IN_CHUNK()), "prev_map": F.lag(map_).over(IN_CHUNK())})
    out = with_session_values(without_halo(near), {"warm_at": S.warm_threshold(F.max(ect))})
    return out.withColumns(
        {
            "region": S.region(rpm, tps, map_, F.col("prev_tps"), F.col("prev_map")), "segment": S.segment(rpm, tps, vss), "is_idle": S.is_idle(rpm, tps, vss),
            "is_warm": F.coalesce(ect >= F.col("warm_at"), F.lit(True)), "engine_on": F.coalesce(rpm > 400, F.lit(False)),
        }
    )


def knock_events(f: DataFrame) -> DataFrame:
    """Runs of knock retard above half a degree, across all borders of chunks."""
    positive = F.when(F.col("kr") > 0, F.col("kr"))
    counted = with_counts(f, {"_positives": F.col("kr") > 0})
    whole = F.coalesce(F.bool_and(F.when(F.col("_positives") <= X.KR_SAMPLE, positive == F.floor(positive))), F.lit(False))
    scaled = with_session_values(counted, {"raw_counts": whole}).withColumn("deg", F.col("kr") * F.when(F.col("raw_counts"), S.KR_RAW_TO_DEG).otherwise(1.0))
    inside = F.coalesce(F.col("deg") > 0.5, F.lit(False))
    runs = with_counts(scaled, {"_inside": inside}).where(inside).withColumn("run", F.col("row_idx") - F.col("_inside"))
    votes = [F.struct(F.count_if(F.col("region") == r).alias("n"), (-F.min(F.when(F.col("region") == r, F.col("row_idx")))).alias("first"), F.lit(r).alias("region")) for r in X.REGIONS]
    peak, seen = F.struct("deg", -F.col("row_idx")), F.when(F.col("tps").isNotNull(), F.col("row_idx"))
    events = runs.groupBy("log_id", "run").agg(
        F.min("row_idx").alias("start_row"), F.count("*").alias("samples"), F.array_max(F.array(*votes)).getField("region").alias("region"), F.max("deg").alias("peak"), F.sum("deg").alias("total"), F.max_by("rpm", peak).alias("rpm"), F.max_by("map", peak).alias("map"),
        F.coalesce(F.min_by("tps", seen) - F.max_by("tps", seen), F.lit(0.0)).alias("drop"),
    )
    return events.select(
        "log_id", "start_row", "samples", "region", S.half_up(F.col("peak")).alias("peak_kr"), S.half_up(F.col("total") / F.col("samples")).alias("avg_kr"), "rpm", S.half_up(F.col("map")).alias("map"), S.half_up(F.col("drop")).alias("tps_drop"),
        (F.col("drop") > 10).alias("tip_out"), (F.col("samples") <= 1).alias("suspect_noise"),
    )


class Machine(Protocol):
    """A state machine over the rows of a chunk, with a finite number of states at its border."""

    states: list[Hashable]
    start: Hashable

    def ends(self, rows: pd.DataFrame, begin: int, size: int) -> list[Hashable]:
        """For each of ``states`` at the chunk's first row, the state behind its last."""

    def idle(self, state: Hashable, size: int) -> Hashable:
        """The state behind a chunk that has no row for the machine."""

    def run(self, rows: pd.DataFrame, begin: int, size: int, state: Hashable) -> pd.DataFrame:
        """The machine's output for the chunk's own rows."""


class GearMachine:
    """Confirmed gears. Its states are the current gear, the pending one, and how often that was seen."""

    start = folds.GEAR_START
    states = list(product((folds.OUTSIDE, 0, 1, 2, 3, 4), (folds.OUTSIDE, 1, 2, 3, 4), range(folds.CONFIRM)))

    def ends(self, rows: pd.DataFrame, begin: int, size: int) -> list[Hashable]:
        now = dict(zip(self.states, self.states, strict=True))
        live = set(self.states)
        for first, end, gear in zip(*folds.gear_runs(rows["valid"].to_numpy(), rows["gear"].to_numpy()), strict=True):
            moved = {s: folds.gear_step(s, gear, end - first)[0] for s in live}
            live = set(moved.values())
            # once entries have met they stay together
            now = {s: moved[x] for s, x in now.items()}
        return [now[s] for s in self.states]

    def idle(self, state: Hashable, size: int) -> Hashable:
        return state

    def run(self, rows: pd.DataFrame, begin: int, size: int, state: Any) -> pd.DataFrame:
        return rows.assign(gear=folds.debounced_gears(rows["valid"].to_numpy(), rows["gear"].to_numpy(), state)).drop(columns="valid")


class SpacedMachine:
    """Events that follow the last one kept by ``gap`` rows. The state is how many rows are still barred."""

    start = 0

    def __init__(self, gap: int):
        self.gap, self.states = gap, list(range(gap))

    def _kept(self, rows: list[int], begin: int, wait: int) -> tuple[list[bool], int]:
        free, keep = begin + wait, []
        for row in rows:
            keep.append(row >= free)
            free = row + self.gap if row >= free else free
        return keep, free

    def ends(self, rows: pd.DataFrame, begin: int, size: int) -> list[Hashable]:
        at = rows["row_idx"].tolist()
        return [max(0, self._kept(at, begin, s)[1] - begin - size) for s in self.states]

    def idle(self, state: Any, size: int) -> Hashable:
        return max(0, state - size)

    def run(self, rows: pd.DataFrame, begin: int, size: int, state: Any) -> pd.DataFrame:
        return rows[self._kept(rows["row_idx"].tolist(), begin, state)[0]]


class AlternatingMachine:
    """As ``SpacedMachine``, and each event kept must be of another kind than the one before."""

    def __init__(self, gap: int, kinds: list[str]):
        self.gap, self.states, self.start = gap, list(product(range(gap), [None, *kinds])), (0, None)

    def _kept(self, rows: list[tuple[int, str]], begin: int, state: Any) -> tuple[list[bool], Any]:
        (wait, last), keep = state, []
        free = begin + wait
        for row, kind in rows:
            keep.append(row >= free and kind != last)
            if keep[-1]:
                free, last = row + self.gap, kind
        return keep, (free, last)

    def ends(self, rows: pd.DataFrame, begin: int, size: int) -> list[Hashable]:
        at = list(zip(rows["row_idx"].tolist(), rows["type"].tolist(), strict=True))
        found = [self._kept(at, begin, s)[1] for s in self.states]
        return [(max(0, free - begin - size), last) for free, last in found]

    def idle(self, state: Any, size: int) -> Hashable:
        return (max(0, state[0] - size), state[1])

    def run(self, rows: pd.DataFrame, begin: int, size: int, state: Any) -> pd.DataFrame:
        return rows[self._kept(list(zip(rows["row_idx"].tolist(), rows["type"].tolist(), strict=True)), begin, state)[0]]


class HuntingMachine:
    """Episodes of shuffling between one pair of gears. The state is how many shifts an episode still covers.

    Rows behind the chunk, up to the reach of an episode, come along as a halo.
    """

    start = 0

    def __init__(self, window: int = 300, least: int = 3):
        # shifts are rows, so an episode covers no more of them than its window has rows
        self.window, self.least, self.states = window, least, list(range(window + 1))

    def _episodes(self, rows: pd.DataFrame) -> tuple[list[int], int]:
        """Reversals of the episode that would begin at each own shift (0: none), and the number of own shifts."""
        at, a, b = rows["row_idx"].tolist(), rows["from_gear"].tolist(), rows["to_gear"].tolist()
        own = int((~rows["halo"]).sum())
        out = []
        for i in range(own):
            reversals, j = 0, i + 1
            while j < len(at) and at[j] - at[i] < self.window:
                reversals += {a[j], b[j]} == {a[i], b[i]} and (b[j] > a[j]) != (b[j - 1] > a[j - 1])
                j += 1
            tps = rows["tps"].iloc[i]
            out.append(reversals if reversals >= self.least and (pd.isna(tps) or tps < 40) else 0)
        return out, own

    def ends(self, rows: pd.DataFrame, begin: int, size: int) -> list[Hashable]:
        found, own = self._episodes(rows)
        left = [0] * own
        for i in range(own - 1, -1, -1):
            after = i + 1 + found[i]
            left[i] = left[after] if after < own else after - own
        return [left[s] if s < own else s - own for s in self.states]

    def idle(self, state: Any, size: int) -> Hashable:
        return state

    def run(self, rows: pd.DataFrame, begin: int, size: int, state: Any) -> pd.DataFrame:
        found, own = self._episodes(rows)
        kept, i = [], state
        while i < own:
            if found[i]:
                kept.append((i, found[i] + 1))
            i += 1 + found[i]
        return rows.iloc[[i for i, _ in kept]][["log_id", "row_idx", "from_gear", "to_gear", "mph", "tps"]].assign(reversals=[n for _, n in kept])


def fold(rows: DataFrame, machine: Machine, schema: str, size: int = CHUNK) -> DataFrame:
    """Run a machine over sessions of any length. ``rows`` have log_id, chunk, row_idx and what the machine reads; halo rows where it wants them."""
    ship_package(rows.sparkSession)
    rows = staged(rows, "chunks")
    numbers = {s: k for k, s in enumerate(machine.states)}

    def ends(chunk: pd.DataFrame) -> pd.DataFrame:
        number = int(chunk["chunk"].iloc[0])
        found = machine.ends(chunk.sort_values("row_idx"), number * size, size)
        return pd.DataFrame({"log_id": chunk["log_id"].iloc[:1], "chunk": [number], "ends": [np.array([numbers[s] for s in found], np.int32)]})

    def entries(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks, state, at, out = chunks.sort_values("chunk"), machine.start, 0, []
        for number, table in zip(chunks["chunk"].tolist(), chunks["ends"].tolist(), strict=True):
            for _ in range(at, number):
                # one idle chunk may change the state; where it does not, more of them do not either
                settled = machine.idle(state, size)
                if settled == state:
                    break
                state = settled
            out.append(numbers[state])
            state, at = machine.states[table[numbers[state]]], number + 1
        return pd.DataFrame({"log_id": chunks["log_id"], "chunk": chunks["chunk"], "state": out})

    tables = rows.groupBy(*KEY).applyInPandas(ends, "log_id long, chunk long, ends array<int>")
    entered = tables.groupBy("log_id").applyInPandas(entries, "log_id long, chunk long, state int")

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        state = machine.states[int(chunk["state"].iloc[0])]
        return machine.run(chunk.drop(columns=["state", "chunk"]).sort_values("row_idx"), int(chunk["chunk"].iloc[0]) * size, size, state)

    return rows.join(entered, KEY).groupBy(*KEY).applyInPandas(run, schema)


def _schema(df: DataFrame, *drop: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in drop)


def gears(f: DataFrame, size: int = CHUNK) -> DataFrame:
    """The confirmed gear of every row (0: none), as ``events.gears`` has it."""
    near = with_halo(f, 1, size=size)
    step = F.coalesce(F.abs(F.col("vss") - F.lag("vss").over(IN_CHUNK())), F.lit(99.0))
    tps = X.channel(f, "tps")
    steady = (F.col("vss") >= 5) & (tps.isNull() | tps.between(8, 35)) & (step < 1.5) & (F.col("rpm") > 1200) & (F.col("rpm") < 2800)
    marked = staged(without_halo(near.withColumn("_steady", F.when(steady, F.col("rpm") / F.col("vss")))), "speeds")
    middles = upper_medians(marked, F.col("_steady"), "cruise_ratio")
    by_chunk = marked.select(*KEY).distinct().join(middles, "log_id", "left")
    rows = marked.join(by_chunk, KEY).withColumn("mph", F.col("vss") * F.when(F.col("cruise_ratio") < 25, S.KPH_TO_MPH).otherwise(1.0))
    ratio = S.gear_ratio(F.col("rpm"), F.col("mph"), F.col("vss"))
    rows = rows.select(*KEY, "row_idx", "rpm", "tps", "vss", "mph", S.half_up(ratio).alias("ratio"), F.coalesce(S.nearest_gear(ratio), F.lit(0)).cast("int").alias("gear"), ratio.isNotNull().alias("valid"))
    return fold(rows, GearMachine(), _schema(rows, "chunk", "valid"), size)


def shifts(g: DataFrame, size: int = CHUNK) -> DataFrame:
    """Gear changes against four rows before, at most one in 15 rows, with their flare, as ``events.shifts`` has them."""
    w = IN_CHUNK()
    rows = with_halo(g, 12, size=size).withColumns({"from_gear": F.lag("gear", 4).over(w), "rpm_at": F.max("rpm").over(w.rowsBetween(-12, -6)), "rpm_peak": F.max("rpm").over(w.rowsBetween(-4, 0))})
    hits = without_halo(rows).where((F.col("row_idx") >= 5) & (F.col("from_gear") > 0) & (F.col("gear") > 0) & (F.col("gear") != F.col("from_gear")))
    flare = F.coalesce(F.greatest(F.col("rpm_peak") - F.col("rpm_at"), F.lit(0.0)), F.lit(0.0))
    named = hits.select(
        *KEY, "row_idx", F.col("from_gear").cast("int").alias("from_gear"), F.col("gear").alias("to_gear"), "rpm_at", S.half_up(F.col("mph")).alias("mph"), "tps", S.half_up_int(flare).alias("flare_rpm"), ((F.col("gear") > F.col("from_gear")) & (flare >= 150)).alias("flared")
    )
    return fold(named, SpacedMachine(15), _schema(named, "chunk"), size)


def converter_events(g: DataFrame, size: int = CHUNK) -> DataFrame:
    """Lock and unlock of the converter, inferred as ``events.converter_events`` does."""
    w = IN_CHUNK()
    frame = lambda a, b: F.collect_list("ratio").over(w.rowsBetween(a, b))
    rows = with_halo(g, 16, size=size).withColumns({"_a": frame(-16, -9), "_b": frame(-8, 0), "gear_before": F.lag("gear", 16).over(w)})
    hits = without_halo(rows).where((F.col("gear") >= 3) & (F.col("gear") == F.col("gear_before")) & (F.col("tps").isNull() | (F.col("tps") <= 45)) & (F.col("mph") >= 30) & (F.size("_a") >= 5) & (F.size("_b") >= 5))
    step = (S.upper_median(F.col("_a")) - S.upper_median(F.col("_b"))) / S.upper_median(F.col("_a"))
    named = hits.select(*KEY, "row_idx", F.when(step > 0.06, "apply").when(step < -0.06, "release").alias("type"), "gear").where("type is not null")
    return fold(named, AlternatingMachine(40, ["apply", "release"]), _schema(named, "chunk"), size)


def hunting(s: DataFrame, size: int = CHUNK) -> DataFrame:
    """Episodes of shuffling between one pair of gears, as ``events.hunting`` has them."""
    rows = with_halo(s, 0, min(300, size), size).select(*KEY, "row_idx", "from_gear", "to_gear", "mph", "tps", "halo")
    if size < 300:
        raise ValueError("an episode reaches 300 rows ahead: chunks must be as long")
    # a chunk that would have nothing but halo has no shift of its own
    own = rows.withColumn("_own", F.max(~F.col("halo")).over(Window.partitionBy(*KEY))).where("_own").drop("_own")
    return fold(own, HuntingMachine(), "log_id long, row_idx long, from_gear int, to_gear int, mph double, tps double, reversals int", size)


def tip_ins(f: DataFrame, size: int = CHUNK) -> DataFrame:
    """Throttle stabs that hold, at most one in 20 rows, as ``events.tip_ins`` has them."""
    w = IN_CHUNK()
    rows = with_halo(f, 5, 7, size).withColumns({"_ahead": F.collect_list("tps").over(w.rowsBetween(1, 5)), "min_o2": F.min("o2_b1").over(w.rowsBetween(0, 7)), "o2_before": F.avg("o2_b1").over(w.rowsBetween(-5, -1))})
    held = F.size(F.filter("_ahead", lambda t: t >= F.col("prev_tps") + 5)) >= 3
    hits = without_halo(rows).where((F.col("tps") - F.col("prev_tps") >= 10) & held)
    named = hits.select(
        *KEY, "row_idx", S.half_up(F.col("tps") - F.col("prev_tps")).alias("dtps"), S.half_up(F.col("prev_tps")).alias("tps_from"), S.half_up(F.col("tps")).alias("tps_to"), "rpm", S.half_up_int(F.col("min_o2")).alias("min_o2"),
        F.coalesce(F.col("min_o2") < 250, F.lit(False)).alias("lean"), F.coalesce(F.col("ect") < F.col("warm_at"), F.lit(False)).alias("cold"), "o2_before",
    )
    return fold(named, SpacedMachine(20), _schema(named, "chunk"), size)


def filled_time(session: DataFrame, size: int = CHUNK) -> DataFrame:
    """Time with gaps filled forward; the row number where under nine tenths of the session are timed."""
    rows = with_session_values(chunked(session, size), {"_timed": F.count("time_s") >= 0.9 * F.count("*")})
    filled = with_last(rows, {"_last": F.col("time_s")})
    return filled.select("log_id", "row_idx", F.when(F.col("_timed"), F.col("_last")).otherwise(F.col("row_idx").cast("double")).alias("play_s"))
