"""State machines that no window expresses: their state depends on what they accepted before.

Each is a plain function over the ordered arrays of one log, applied to batches of
whole logs. All but the gear machine see only candidate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from revscope.cluster import ship_package

CONFIRM = 3


OUTSIDE, UNKNOWN = -1, -2


def gear_runs(valid: np.ndarray, near: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Begin, end and state of each run of rows of equal state."""
    state = np.where(valid, np.where(near == 0, OUTSIDE, near), UNKNOWN)
    heads = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]])) if len(state) else np.zeros(0, np.int64)
    return heads.tolist(), np.append(heads[1:], len(state))[: len(heads)].tolist(), state[heads].tolist()


def gear_step(state: tuple[int, int, int], gear: int, rows: int) -> tuple[tuple[int, int, int], int]:
    """The machine after a run of ``rows`` rows of one gear, and after how many of them the gear changes (``rows``: never)."""
    current, pending, seen = state
    if gear in (UNKNOWN, current):
        return (current, OUTSIDE, 0), rows
    first = seen + 1 if gear == pending else int(gear != OUTSIDE)
    change = max(0, CONFIRM - first)
    if change < rows:
        return (gear, OUTSIDE, 0), change
    return (current, gear, first + rows - 1), rows


#: No gear confirmed, none pending.
GEAR_START = (0, OUTSIDE, 0)


def debounced_gears(valid: np.ndarray, near: np.ndarray, state: tuple[int, int, int] = GEAR_START) -> np.ndarray:
    """The confirmed gear at each row (0: none). ``near`` is the nearest gear, 0 outside every band.

    A change needs three rows in a row; a row without speed drops the pending
    change but keeps the gear. Being outside every band is a state like a gear:
    it clears after three rows, or four when a change was pending.
    """
    out = np.zeros(len(valid), dtype=np.int32)
    # within a run of equal state the gear changes at most once
    for begin, end, gear in zip(*gear_runs(valid, near), strict=True):
        before = state[0]
        state, change = gear_step(state, gear, end - begin)
        out[begin : begin + change] = max(before, 0)
        out[begin + change : end] = max(state[0], 0)
    return out


def spaced(rows: np.ndarray, gap: int) -> np.ndarray:
    """Which events stay when each must follow the last one kept by ``gap`` rows."""
    keep, last = np.zeros(len(rows), bool), None
    for i, row in enumerate(rows.tolist()):
        if last is None or row - last >= gap:
            keep[i], last = True, row
    return keep


def alternating(rows: np.ndarray, kinds: np.ndarray, gap: int) -> np.ndarray:
    """As ``spaced``, and each kept event must be of another kind than the one before."""
    keep, last, kind = np.zeros(len(rows), bool), None, None
    for i, (row, k) in enumerate(zip(rows.tolist(), kinds.tolist(), strict=True)):
        if (last is None or row - last >= gap) and k != kind:
            keep[i], last, kind = True, row, k
    return keep


def hunting_episodes(rows: np.ndarray, low: np.ndarray, high: np.ndarray, up: np.ndarray, tps: np.ndarray, window: int = 300, least: int = 3) -> list[tuple[int, int]]:
    """(index of the first shift, reversals) of episodes of shuffling between one pair of gears at light throttle."""
    out, i = [], 0
    while i < len(rows):
        reversals, j = 0, i + 1
        while j < len(rows) and rows[j] - rows[i] < window:
            reversals += int(low[j] == low[i] and high[j] == high[i] and up[j] != up[j - 1])
            j += 1
        if reversals >= least and (np.isnan(tps[i]) or tps[i] < 40):
            out.append((i, reversals))
            i += reversals
        i += 1
    return out


def log_spans(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Begin and end of each log in rows that stand log by log."""
    ids = rows["log_id"].to_numpy()
    new = (ids[1:] != ids[:-1]) & ~(pd.isna(ids[1:]) & pd.isna(ids[:-1]))
    return pairwise([0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]) if len(ids) else iter(())


def each_log(rows: pd.DataFrame, fold: Callable[..., np.ndarray], *columns: str) -> np.ndarray:
    """What a fold over arrays says of each row, every log on its own."""
    arrays = [rows[c].to_numpy() for c in columns]
    said = [fold(*(a[begin:end] for a in arrays)) for begin, end in log_spans(rows)]
    return np.concatenate(said) if said else np.zeros(0, bool)


def whole_logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come log by log as frames of whole logs: the last log of a batch waits for the rest of it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        *_, (last, _) = log_spans(batch)
        before, first = held[-1]["log_id"].iat[-1] if held else None, batch["log_id"].iat[0]
        if held and before != first and not (pd.isna(before) and pd.isna(first)):
            yield pd.concat(held, ignore_index=True)
            held = []
        if last:
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def per_log(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a fold to the rows of whole logs in order.

    ``fn`` gets many logs at a time, as a call for each log alone costs more than the fold of
    its rows; it keeps them apart with ``each_log`` or ``log_spans``.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(fn, whole_logs(batches))

    return df.repartition("log_id").sortWithinPartitions("log_id", "row_idx").mapInPandas(run, schema)


def keep_spaced(df: DataFrame, gap: int) -> DataFrame:
    schema = df.schema.simpleString()[7:-1].replace(":", " ")
    return per_log(df, lambda rows: rows[each_log(rows, lambda at: spaced(at, gap), "row_idx")], schema)
