"""Prediction by partial matching over bytes with frozen statistics.

A model is a trie of byte strings of up to ``order + 1`` bytes with their counts:
the string without its last byte is a context, the last byte a symbol seen in it.
Coding a byte starts at the longest context that the trie holds. A symbol known
there gets ``(n - 1/2) / T``: its count, less one half, over the context's count T.
The escape gets the rest, ``(r + q / 2) / T`` with q the number of symbols that the
context knows and r the count of those too rare to be held, and coding goes on in
the next shorter context, where the symbols of the longer one are excluded. The last
resort is a uniform choice among the bytes that no context knows.

A model holds every string of its texts; none is dropped for being rare.

Texts stand between NUL bytes: ``order`` before the first byte, one after the
last, which codes the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, mix64, slices, table_bytes

SLICE = 2 << 20
#: Local gram counts are merged when so many entries have gathered.
MERGE = 4 << 20


def windows(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed ``order + 1`` bytes that end at each coded byte, and per text where its own begin."""
    lengths = np.diff(offsets)
    n = len(lengths)
    buffer = np.zeros(len(raw) + order * n + 1, np.uint64)
    buffer[np.arange(len(raw)) + order * (np.repeat(np.arange(n), lengths) + 1)] = raw
    packed = np.zeros(len(buffer) - order, np.uint64)
    for k in range(order + 1):
        packed = (packed << np.uint64(8)) | buffer[k : k + len(packed)]
    # the window of text i's j-th byte begins j places behind the text's own padding
    starts = offsets[:-1] + order * np.arange(n)
    if order > 1:
        keep = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int(lengths.sum()) + n)
        packed = packed[keep]
    return packed, np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with their summed counts, as ``merged`` gives them, with less memory: the parts are sorted as they are and need only be merged."""
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def gathered(parts: list[tuple[np.ndarray, np.ndarray]], part: tuple[np.ndarray, np.ndarray]) -> None:
    """Add a part to ``parts``, which are joined as they grow alike: so about twice the distinct keys are held and not those of each part."""
    parts.append(part)
    while len(parts) > 1 and 2 * len(parts[-1][0]) >= len(parts[-2][0]):
        last = parts.pop()
        parts[-1] = joined([parts[-1], last])


def level_tables(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The strings of k + 1 bytes that end windows with these counts, and their contexts of k bytes."""
    strings, n = merged(grams & np.uint64((1 << (8 * (k + 1))) - 1), counts)
    contexts, above = merged(strings >> np.uint64(8), n)
    return (strings, n.astype(np.float64)), (contexts, above.astype(np.float64))


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(model, gram, n) over texts with the columns model and text; grams are counted per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for model, parts in held.items():
                keys, counts = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for at in range(0, len(keys), 1 << 17):
                    part = keys[at : at + (1 << 17)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + (1 << 17)])], names=["model", "gram", "n"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                models = batch.column(0).to_pylist()
                for model in dict.fromkeys(models):
                    own = batch.filter(pa.array([m == model for m in models])) if len(set(models)) > 1 else batch
                    keys, counts = np.unique(windows(*table_bytes(own.column(1)), order)[0], return_counts=True)
                    held.setdefault(model, []).append((keys, counts))
                    size += len(keys)
            if size > MERGE:
                held = {m: [merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for m, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > MERGE // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    local = arrow_map(texts.select("model", "text"), run, "model string, gram long, n long")
    return local.groupBy("model", "gram").agg(F.sum("n").alias("n"))


class Model:
    """The held strings of one model, level by level."""

    def __init__(self, order: int, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        """``grams[k]``: sorted strings of k + 1 bytes and their counts; ``contexts[k]``: sorted contexts of k bytes and their counts."""
        self.order, self.grams, self.contexts = order, grams, contexts
        self.known, self.rare, self.left = [], [], []
        for k in range(order + 1):
            keys, counts = grams[k]
            at = np.searchsorted(contexts[k][0], keys >> np.uint64(8))
            n = len(contexts[k][0])
            self.known.append(np.bincount(at, minlength=n).astype(np.float64))
            self.rare.append(contexts[k][1] - np.bincount(at, weights=counts, minlength=n))
            if k:
                # what the shorter context has left once this context's symbols are excluded
                mask = np.uint64((1 << (8 * k)) - 1)
                shorter = np.searchsorted(grams[k - 1][0], keys & mask)
                parent = np.searchsorted(contexts[k - 1][0], contexts[k][0] & np.uint64((1 << (8 * (k - 1))) - 1))
                self.left.append(contexts[k - 1][1][parent] - np.bincount(at, weights=grams[k - 1][1][shorter], minlength=n))
            else:
                self.left.append(np.zeros(n))

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each packed window."""
        out = np.zeros(len(packed))
        todo = np.arange(len(packed))
        above = np.full(len(packed), -1)
        for k in range(self.order, -1, -1):
            w = packed[todo]
            c, has = self._find(self.contexts[k][0], (w >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
            g, hit = self._find(self.grams[k][0], w & np.uint64((1 << (8 * (k + 1))) - 1))
            hit &= has
            total, known = np.zeros(len(todo)), np.zeros(len(todo))
            total[has], known[has] = self.contexts[k][1][c[has]], self.known[k][c[has]]
            up = above[todo]
            escaped = has & (up >= 0)
            if escaped.any():
                total[escaped] = self.left[k + 1][up[escaped]]
                known[escaped] -= self.known[k + 1][up[escaped]]
            live = has & (total > 0)
            part = np.ones(len(todo))
            part[live] = self.rare[k][c[live]] + known[live] / 2
            part[hit] = self.grams[k][1][g[hit]] - 0.5
            out[todo[live]] += np.log10(part[live] / total[live])
            above[todo[has]] = c[has]
            todo = todo[~hit]
        taken = self.known[0][0] if len(self.known[0]) else 0
        out[todo] -= np.log10(max(1.0, 256 - taken))
        return out


def model_of(counts: DataFrame, order: int) -> dict[str | None, Model]:
    """One model for each value of ``model`` in (model, gram, n). What reaches the driver is bounded by the texts counted, a bounded sample, or by the alphabet: 256^(order + 1) strings."""
    levels = F.explode(F.array([F.struct(F.lit(k).alias("k"), (F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1) if k < 7 else F.col("gram")).alias("g")) for k in range(order + 1)]))
    strings = counts.select("model", "n", levels.alias("x")).groupBy("model", "x.k", "x.g").agg(F.sum("n").alias("n"))
    parents = counts.select("model", "n", levels.alias("x")).groupBy("model", "x.k", F.shiftright("x.g", 8).alias("g")).agg(F.sum("n").alias("n"))
    held, above = strings.toPandas(), parents.toPandas()
    own = [{None if m != m else m: f.sort_values(["k", "g"]) for m, f in frame.groupby("model", dropna=False)} for frame in (held, above)]
    levels_of = lambda frame: [(f["g"].to_numpy().astype(np.uint64), f["n"].to_numpy().astype(np.float64)) for k in range(order + 1) for f in [frame[frame["k"] == k]]]
    return {m: Model(order, *(levels_of(frames[m]) for frames in own)) for m in own[0]}


class Scorer:
    """Models applied to whole texts, with a direct-mapped memo of the windows met before."""

    def __init__(self, models: list[Model], slots: int = 1 << 20):
        self.models, self.slots = models, slots
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.zeros((slots, len(models)), np.float32)
        self.full = np.zeros(slots, bool)

    def windows(self, packed: np.ndarray) -> np.ndarray:
        slot = (mix64(packed) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)
        hit = (self.keys[slot] == packed) & self.full[slot]
        values = self.values[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            unique, at = np.unique(packed[miss], return_inverse=True)
            found = np.stack([m.log10(unique) for m in self.models], axis=1).astype(np.float32)
            values[miss] = found[at]
            place = slot[miss]
            self.keys[place], self.values[place], self.full[place] = packed[miss], found[at], True
        return values

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text (row) and model (column) the log10 of the probability of the text and its end."""
        packed, starts = windows(raw, offsets, self.models[0].order)
        values = self.windows(packed).astype(np.float64)
        return np.add.reduceat(values, starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, len(self.models)))
