"""Substring dedup: words covered by a 50-word window that also starts in an earlier document go.

1. Each text sends the minimizers of its windows (the smallest hash among the word
   runs inside a window, so equal windows have equal minimizers). A window whose
   minimizer occurs in one text alone repeats nowhere.
2. The remaining windows are suffixes of their texts. They are dealt to groups by a
   prefix of varying length: the suffixes that hold one minimizer run go together,
   and neighbours among them travel as one run of words, so that a suffix costs a
   few words and not fifty. Where a run is in very many texts, suffixes are dealt by
   the whole window instead, and if even that is in very many, by a salt beside it.
3. A group's suffixes become a suffix tree: suffixes sorted by their words, and the
   lengths of the prefixes that neighbours have in common. An internal node of
   window depth or more is a repeat; its leaf in the smallest doc_id keeps its words,
   the leaves in later documents lose theirs. Words are compared as they are: hashes
   deal suffixes to groups, but no hash decides what repeats.
4. Where a group was salted, the leaves that kept their words meet in fewer groups,
   until one group has seen all suffixes of a window.

Runs of words that are equal within a batch of texts are sent once, from the
smallest doc_id; those of the others are repeats at once. So a passage in very many
texts is one row for each batch of texts. A group holds about ``group_rows``
suffixes, and one prefix is in at most ``hot`` rows of a group.

Defined results: a null or empty text has no words; texts of fewer words than a
window lose none; repeated windows inside one document alone stay; rows that
repeat a doc_id count as one document and lose nothing to each other, and where
their texts differ each is judged by its own; null ids come before all others.
Extra columns are dropped by ``removals`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, bitmap_split, documents, grouped, hash_words, keyed, mix64, slices, staged, table_bytes

WINDOW = 50
#: Words of the runs that minimizers are chosen from.
RUN = 20
#: Suffixes of a group, on average.
GROUP_ROWS = 100_000
#: Texts that may share a minimizer before its suffixes are dealt by the whole window, and rows of one window in a group.
HOT = 5_000
SLICE = 1 << 20
LOWEST = -(2**63)
_R = 0xD6E8FEB86659FD93


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words; the run at place i begins with word i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # doubling: a run of length a + b is hashed from its two parts
    have: dict[int, np.ndarray] = {1: words}
    size, parts = 1, []
    while size <= length:
        if length & size:
            parts.append(size)
        if size * 2 <= length:
            h = have[size]
            have[size * 2] = mix64(h[:-size] * np.uint64(_R) + h[size:]) if len(h) > size else np.zeros(0, np.uint64)
        size *= 2
    at = 0
    for size in reversed(parts):
        out = mix64(out * np.uint64(_R) + have[size][at : at + n])
        at += size
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    out = x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(words: np.ndarray, firsts: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, place of its first word, word hashes) of the texts with at least one window."""
    for row in np.flatnonzero(np.diff(firsts) >= window).tolist():
        yield row, int(firsts[row]), words[firsts[row] : firsts[row + 1]]


#: Hashes of all runs of so many words: any function of the words serves, it only deals suffixes to groups.
Hashes = Callable[[np.ndarray, int], np.ndarray]


def _minimizers(words: np.ndarray, window: int, run: int, hashes: Hashes) -> np.ndarray:
    return sliding_min(hashes(words, run), window - run + 1)


def _text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _shared_minimizers(texts: DataFrame, window: int, run: int, hashes: Hashes) -> DataFrame:
    """(row_key, keys, rows): the minimizers of each text that other texts have too, and how many texts have them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                words, _, _, firsts = hash_words(*table_bytes(_text_of(batch)), lower=False)
                for row, _, own in _windows(words, firsts, window):
                    found = np.unique(_minimizers(own, window, run, hashes))
                    keys.append(found)
                    rows.append(np.full(len(found), ids[row]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows))], names=["key", "row_key"])

    keys = staged(arrow_map(texts.select("row_key", "text"), emit, "key long, row_key long"), "minimizers")
    common = keys.groupBy("key").agg(F.min("row_key").alias("least"), F.max("row_key").alias("most"), F.count("*").alias("n")).where("least < most")
    found = keys.join(staged(common.select("key", "n"), "common-minimizers"), "key")
    return found.groupBy("row_key").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("rows"))


SUFFIXES = "row_key long, doc_order long, prefix long, parts int, start int, n int, repeat boolean, words string"


def _word_runs(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by one space, and where each begins and ends in that."""
    text = text.translate(_TO_SPACE)
    if (begins[1:] - ends[:-1] == 1).all():
        return text, begins, ends
    joined = b" ".join([text[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    sizes = ends - begins
    begins = np.cumsum(sizes + 1) - sizes - 1
    return joined, begins, begins + sizes


_TO_SPACE = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _suffixes(candidates: DataFrame, window: int, run: int, hot: int, hashes: Hashes) -> DataFrame:
    """A row for each run of ``n`` suffixes that may repeat, with the words of their windows; ``repeat`` marks those whose words an earlier document of the batch has too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 * SLICE):
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                row_keys, orders = (col[c].to_numpy(zero_copy_only=False) for c in ("row_key", "doc_order"))
                raw, offsets = table_bytes(col["text"])
                words, begins, ends, firsts = hash_words(raw, offsets, lower=False)
                out: list[tuple] = []
                for row, at, own in _windows(words, firsts, window):
                    keys = col["keys"][row].values.to_numpy(zero_copy_only=False)
                    by_key = np.argsort(keys)
                    keys, rows = keys[by_key], col["rows"][row].values.to_numpy(zero_copy_only=False)[by_key]
                    least = _minimizers(own, window, run, hashes).view(np.int64)
                    place = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
                    shared = keys[place] == least
                    many = shared & (rows[place] > hot)
                    # a run of suffixes ends where the minimizer changes; suffixes of minimizers in very many texts stand alone
                    head = np.concatenate([[True], least[1:] != least[:-1]]) | many
                    begin = np.flatnonzero(head & shared)
                    heads = np.append(np.flatnonzero(head), len(least))
                    end = heads[np.searchsorted(heads, begin, "right")]
                    text, a, b = _word_runs(raw[offsets[row] : offsets[row + 1]].tobytes(), begins[at : at + len(own)] - offsets[row], ends[at : at + len(own)] - offsets[row])
                    alone = many[begin]
                    prefix, parts = least[begin].copy(), np.ones(len(begin), np.int64)
                    if alone.any():
                        prefix[alone] = hashes(own, window).view(np.int64)[begin[alone]]
                        parts[alone] = -(-rows[place][begin[alone]] // hot)
                    spans = zip(a[begin].tolist(), b[end + window - 2].tolist(), strict=True)
                    out += zip([row_keys[row]] * len(begin), [orders[row]] * len(begin), prefix.tolist(), parts.tolist(), begin.tolist(), (end - begin).tolist(), [text[i:j] for i, j in spans], strict=True)
                if not out:
                    continue
                columns = list(zip(*out, strict=True))
                spelled = pa.array(columns[6], pa.binary()).dictionary_encode()
                code, order = spelled.indices.to_numpy(), np.array(columns[1])
                first = np.full(len(spelled.dictionary), np.iinfo(np.int64).max)
                np.minimum.at(first, code, order)
                repeat = order > first[code]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                texts = pa.array([None if r else w for w, r in zip(columns[6], repeat.tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), pa.array(repeat), texts], names=["row_key", "doc_order", "prefix", "parts", "start", "n", "repeat", "words"])

    return arrow_map(candidates.select("row_key", "doc_order", "text", "keys", "rows"), emit, SUFFIXES)


class SuffixTree:
    """The suffixes of runs of words, as a suffix tree cut below ``window`` words.

    ``texts[k]`` holds the words of ``counts[k]`` suffixes, ``window - 1`` more words
    than that. ``order`` lists the leaves in the order of their words and ``common``
    the number of words that each has in common with the leaf before it; a node of
    depth d covers leaves between which no ``common`` is less than d.
    """

    def __init__(self, texts: pa.Array, counts: np.ndarray, window: int):
        lists = pc.split_pattern(texts, " ")
        # the dictionary holds each word as it is spelled, so equal numbers are equal words
        words = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        sizes = counts + window - 1
        firsts = np.cumsum(sizes) - sizes
        self.leaves = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        self.window = window
        # ranks of runs of 1, 2, 4, ... words: pairs of ranks sort as their words do
        self.ranks = [words]
        while 2 << (len(self.ranks) - 1) <= window:
            below, size = self.ranks[-1], 1 << (len(self.ranks) - 1)
            self.ranks.append(self._paired(below[:-size], below[size:]))
        size = 1 << (len(self.ranks) - 1)
        whole = self._paired(self.ranks[-1][self.leaves], self.ranks[-1][self.leaves + window - size])
        self.order = np.argsort(whole, kind="stable")
        self.common = self._common(self.leaves[self.order[:-1]], self.leaves[self.order[1:]])

    @staticmethod
    def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words, up to the window, that the suffixes at i and j have in common at their beginning."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            size, ranks = 1 << level, self.ranks[level]
            live = np.flatnonzero(out + size <= self.window)
            live = live[ranks[i[live] + out[live]] == ranks[j[live] + out[live]]]
            out[live] += size
        return out

    def nodes(self) -> np.ndarray:
        """For each leaf in order the number of its node of window depth (a leaf without such a node has one of its own)."""
        return np.cumsum(np.concatenate([[0], self.common < self.window]))[: len(self.order)]

    def later(self, docs: np.ndarray) -> np.ndarray:
        """Which leaves share a node of window depth with a leaf of a smaller document; ``docs`` is by leaf."""
        out = np.zeros(len(docs), bool)
        if len(docs):
            node, doc = self.nodes(), docs[self.order]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            out[self.order] = doc > np.minimum.reduceat(doc, heads)[node]
        return out


LATE = "row_key long, doc_order long, prefix long, parts int, start int, n int, late boolean, words string"


def _judged(suffixes: DataFrame, window: int, group_rows: int, tree: type[SuffixTree]) -> DataFrame:
    """Runs of suffixes that are late, and (``late`` false) suffixes that must meet those of other groups."""
    n_groups = max(1, -(-(suffixes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // group_rows))
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row_key"), F.col("parts"))).otherwise(0)
    groups = suffixes.withColumn("cell", F.pmod(F.xxhash64("prefix", salt), F.lit(n_groups)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cell"]):
            col = {n: table.column(n).combine_chunks() for n in table.column_names}
            counts, starts, parts = (col[c].to_numpy().astype(np.int64) for c in ("n", "start", "parts"))
            orders = col["doc_order"].to_numpy()
            run = np.repeat(np.arange(len(counts)), counts)
            late = tree(col["words"], counts, window).later(orders[run])
            # neighbouring late suffixes of a run are one row
            change = np.concatenate([[True], (late[1:] != late[:-1]) | (run[1:] != run[:-1])])
            begin = np.flatnonzero(change)
            size = np.diff(np.append(begin, len(late)))
            more = parts[run[begin]] > 1
            keep = late[begin] | more
            begin, size = begin[keep], size[keep]
            row, is_late = run[begin], late[begin]
            start = starts[row] + begin - (np.cumsum(counts) - counts)[row]
            # a suffix that goes on stands alone in its run
            words = pc.if_else(pa.array(is_late), pa.scalar(None, pa.string()), col["words"].take(pa.array(row)))
            same = [col[c].take(pa.array(row)) for c in ("row_key", "doc_order", "prefix")]
            columns = [*same, pa.array(parts[row], pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(is_late), words]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_order", "prefix", "parts", "start", "n", "late", "words"])

    names = ["cell", "row_key", "doc_order", "prefix", "parts", "start", "n", "words"]
    return arrow_map(groups.select(names).repartition("cell").sortWithinPartitions("cell"), judge, LATE)


def repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, group_rows: int = GROUP_ROWS, hot: int = HOT, hashes: Hashes = run_hashes, tree: type[SuffixTree] = SuffixTree) -> DataFrame:
    """(row_key, doc_order, starts, counts): the runs of windows to be removed, for documents with the columns of ``_rows``."""
    if window < run:
        raise ValueError("a window holds at least one run")
    if hot < 2:
        raise ValueError("salted groups must shrink")
    shared = staged(_shared_minimizers(docs, window, run, hashes), "shared-minimizers")
    near, _ = bitmap_split(docs, shared, "row_key")
    suffixes = staged(_suffixes(near.join(shared, "row_key"), window, run, hot, hashes), "suffixes")
    names = ["row_key", "doc_order", "start", "n"]
    late, todo = suffixes.where("repeat").select(names), suffixes.where("not repeat")
    while True:
        judged = staged(_judged(todo, window, group_rows, tree), "judged")
        late = late.unionByName(judged.where("late").select(names))
        todo = judged.where("not late").withColumn("parts", F.ceil(F.col("parts") / hot).cast("int"))
        if todo.isEmpty():
            return late.groupBy("row_key", "doc_order").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What a row is known by: its place in the order of documents, and a number for that and its text."""
    rows = docs.withColumn("doc_order", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    return rows.select("doc_order", F.xxhash64("doc_order", text_col).alias("row_key"), F.col(text_col).alias("text"))


def _covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window of the runs of ``counts`` windows that begin at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_repeats(docs: DataFrame, id_col: str, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the columns ``__starts`` and ``__counts``. Only texts that may have repeats are shuffled for the join."""
    found = staged(found.select(F.col("row_key").alias("__key"), F.col("doc_order").alias("__order"), F.col("starts").alias("__starts"), F.col("counts").alias("__counts")), "repeats")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    near, far = bitmap_split(docs.withColumns({"__order": order, "__key": F.xxhash64(order, text_col)}), found, "__key")
    none = F.lit(None).cast("array<int>")
    return near.join(found, ["__key", "__order"], "left").unionByName(far.withColumns({"__starts": none, "__counts": none})).drop("__order", "__key")


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Per row: words, words removed, and the kept words joined by one space."""
    raw, offsets = table_bytes(_text_of(batch))
    _, begins, ends, firsts = hash_words(raw, offsets, lower=False)
    text = raw.tobytes()
    starts, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("__starts", "__counts"))
    for row in range(batch.num_rows):
        a, b = int(firsts[row]), int(firsts[row + 1])
        gone = np.zeros(b - a, bool)
        if starts[row].is_valid:
            gone = _covered(b - a, *(c[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (starts, counts)), window)
        at = np.flatnonzero(~gone) + a
        words = [text[i:j] for i, j in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]
        yield row, b - a, int(gone.sum()), b" ".join(words)


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document n_words, n_removed and the checksum of the kept words joined by one space."""
    found = repeats(_rows(docs, id_col, text_col), window, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out = [(n, gone, hashlib.sha256(kept).hexdigest()) for _, n, gone, kept in _kept(batch, window)]
                n, gone, sums = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_repeats(keyed(docs, id_col, text_col), "doc_id", found).select("doc_id", "text", "__starts", "__counts")
    return arrow_map(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The documents without their repeats: texts that lose words become their kept words, others stay as they are.

    Needs the columns doc_id and text; n_chars, where it exists, follows the text.
    """
    names = docs.columns
    found = repeats(_rows(docs, "doc_id", "text"), window, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = _text_of(batch).to_pylist()
                for row, _, gone, kept in _kept(batch, window):
                    if gone:
                        texts[row] = kept.decode()
                columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    marked = _with_repeats(docs, "doc_id", found)
    out = arrow_map(marked, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of all documents."""
    return removals(documents(spark, sf_dir))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS t FROM starts),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM late),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS t, count(*) AS n
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.p = g.p WHERE g.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {"op6_substring_dedup": ORACLE}
