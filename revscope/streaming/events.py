"""Events on live telemetry: throttle stabs with state and timers, stabs and downshifts by an interval join.

The state of a log is the few rows that later rows can still ask for and the last stab
kept, and it ends with the log: an event-time timer, moved on with every row, gives out
what was waiting for rows that never came and clears the state. So what is kept grows
with the logs that are running, not with those that ever ran.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from revscope.cluster import ship_package

#: A stab opens by 10 % in one row, holds for three of five rows, is watched for eight and bars others for 20.
JUMP, HOLD, HELD_ROWS, HELD_LEAST, WATCHED, GAP, LEAN_MV = 10.0, 5.0, 5, 3, 8, 20, 250.0
TIP_INS = "log_id long, row_idx long, dtps double, tps_from double, tps_to double, min_o2 long, lean boolean"
ROW = ["row_idx", "tps", "o2_b1"]


def _half_up(x: float, places: int = 2) -> float:
    scale = 10.0**places
    return float((x * scale + 0.5) // 1) / scale


class StabFinder:
    """Stabs of one log's rows in order; knows nothing of streams.

    ``rows`` holds the rows that are still to be judged or that the next one is judged by, ``judged``
    how many of them were judged already (the one before the next is kept for its throttle).
    """

    def __init__(self, rows: list[tuple[int, float | None, float | None]], judged: int, last: int | None):
        self.rows, self.judged, self.last = rows, judged, last

    def add(self, rows: list[tuple[int, float | None, float | None]], ended: bool = False) -> list[tuple]:
        """The stabs that are certain with these rows; all that are left where the log has ended."""
        self.rows = [*self.rows, *rows]
        found = []
        while self.judged < len(self.rows) and (ended or len(self.rows) - self.judged >= WATCHED):
            i = self.judged
            if hit := self._judge(i):
                found.append(hit)
                self.last = self.rows[i][0]
            self.judged += 1
        drop = max(0, self.judged - 1)
        self.rows, self.judged = self.rows[drop:], self.judged - drop
        return found

    def _judge(self, i: int) -> tuple | None:
        row, tps, _ = self.rows[i]
        before = self.rows[i - 1][1] if i else None
        if tps is None or before is None or tps - before < JUMP or (self.last is not None and row - self.last < GAP):
            return None
        ahead = [t for _, t, _ in self.rows[i + 1 : i + 1 + HELD_ROWS] if t is not None]
        if sum(t >= before + HOLD for t in ahead) < HELD_LEAST:
            return None
        seen = [mv for _, _, mv in self.rows[i : i + WATCHED] if mv is not None]
        low = min(seen) if seen else None
        return row, _half_up(tps - before), _half_up(before), _half_up(tps), None if low is None else int((low + 0.5) // 1), low is not None and low < LEAN_MV


def _rows(table: pd.DataFrame) -> list[tuple[int, float | None, float | None]]:
    return [(int(r), None if pd.isna(t) else float(t), None if pd.isna(o) else float(o)) for r, t, o in zip(*(table[c] for c in ROW), strict=True)]


class TipIns(StatefulProcessor):
    """The finder with its rows as list state and a timer that ends the log."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row_idx long, tps double, o2_b1 double")
        self.place = handle.getValueState("place", "judged int, last long")

    def _finder(self) -> StabFinder:
        if not self.place.exists():
            return StabFinder([], 0, None)
        judged, last = self.place.get()
        return StabFinder([tuple(r) for r in self.rows.get()], int(judged), None if last is None or last < 0 else int(last))

    @staticmethod
    def _frame(log: int, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["row_idx", "dtps", "tps_from", "tps_to", "min_o2", "lean"])
        out["min_o2"] = out["min_o2"].astype("Int64")
        out.insert(0, "log_id", log)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("row_idx", kind="stable")
        finder = self._finder()
        found = finder.add(_rows(batch))
        self.rows.put([tuple(r) for r in finder.rows])
        self.place.update((finder.judged, -1 if finder.last is None else finder.last))
        until = int(batch["at"].max().timestamp() * 1000) + self.silence_ms
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        if found:
            yield self._frame(key[0], found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self._finder().add([], ended=True)
        self.rows.clear()
        self.place.clear()
        if found:
            yield self._frame(key[0], found)

    def close(self) -> None:
        pass


def tip_in_stream(stream: DataFrame, late: str = "10 seconds", silence_s: float = 30.0) -> DataFrame:
    """The stabs of ``events.tip_ins`` (but for what needs a whole log), each as soon as it is certain.

    Rows of a log come in order, as loggers write them. A log that is silent for ``silence_s`` of event
    time has ended. Needs the RocksDB state store: see ``use_rocksdb``.
    """
    ship_package(stream.sparkSession)
    rows = stream.select("log_id", *ROW, "at").withWatermark("at", late)
    return rows.groupBy("log_id").transformWithStateInPandas(TipIns(int(silence_s * 1000)), TIP_INS, "Append", "EventTime")


def use_rocksdb(spark) -> None:  # noqa: ANN001
    """State with timers is kept in RocksDB, which spills to disk and is checkpointed with the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def kickdown_stream(stabs: DataFrame, shifts: DataFrame, late: str = "10 seconds", rows: int = 20, sample_s: float = 0.145) -> DataFrame:
    """Stabs (log_id, row_idx, at) with the downshifts (log_id, down_row, from_gear, to_gear, at) of the 20 rows behind each.

    Both are streams. The bound in time lets Spark drop what no later row can meet, so neither side's state
    outlives the watermark; a stab without a downshift comes out with nulls when the watermark has passed it.
    """
    a = stabs.select("log_id", "row_idx", "at").withWatermark("at", late)
    b = shifts.where("to_gear < from_gear").select(F.col("log_id").alias("shift_log"), "down_row", F.col("at").alias("down_at")).withWatermark("down_at", late)
    reach = F.expr(f"interval {int((rows + 1) * sample_s * 1000)} milliseconds")
    near = (F.col("log_id") == F.col("shift_log")) & (F.col("down_row") >= F.col("row_idx")) & (F.col("down_row") <= F.col("row_idx") + rows) & (F.col("down_at") >= F.col("at") - F.expr("interval 1 second")) & (F.col("down_at") <= F.col("at") + reach + F.expr("interval 1 second"))
    return a.join(b, near, "left_outer").select("log_id", "row_idx", "down_row")
