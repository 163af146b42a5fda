"""Language-model scores: a byte model by partial matching, beside a word-count base.

Training texts give two things: counts of all their strings of up to ``ORDER + 1``
bytes, which make the context trie (see ``ppm``), and counts of words. Both grow
with the corpus, and nothing is dropped from either. So the documents are dealt to
chunks by a hash of doc_id and text, and each chunk asks for what its own texts need: it
sends the distinct words and windows of its texts, with their counts in its
training texts, to buckets. Windows meet in a bucket by the three bytes before the
last one, so a bucket holds all strings of four bytes and more that bear on its
windows; those of up to three bytes are bounded by the alphabet (2^24) and are
broadcast. A bucket sums the counts and answers every chunk with the total of each
word and the log probability of each window that it asked for.

Questions and answers are one row for each chunk and bucket: sorted numbers, as
differences, byte by byte (``_planes``), so that they compress.

No task reads more than ``FAN`` such rows. Beyond that many chunks the sums are made in
levels: ``FAN`` chunks meet in wide buckets, their sums are dealt to ``FAN`` narrower
buckets each and meet the sums of ``FAN`` - 1 other groups, until a bucket is as narrow as
it shall be and holds one group; the answers go back the same way. So the rows of a level
are ``FAN`` for each chunk, however many chunks there are, and a very common context
reaches a task as the distinct windows of ``FAN`` sums (of one context there are at most
2^24 at the default order), not as one row of each chunk.

Defined results: a null text is empty and consists of the end alone; a null id is
held out; with no training text the base is that of an empty table (N = 0, V = 0)
and the model is uniform over bytes; rows that repeat in both doc_id and text
are in one chunk and are scored each; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import ship_package
from revscope.llm._common import bound_batches, documents, hash_words, keyed, mix64, release, released, released_pair, slices, staged, table_bytes
from revscope.llm.ppm import Model, gathered, gram_counts, joined, level_tables, merged, model_of, windows

ORDER = 5
#: Strings of up to so many bytes are broadcast, longer ones are asked for.
SHORT = 3
CHUNK_BYTES = 24 << 20
SLICE = 1 << 20
#: Chunks, or sums over groups of chunks, that meet in one task.
FAN = 64
QUESTIONS = "chunk int, bucket int, words binary, word_counts binary, grams binary, gram_counts binary"
ANSWERS = "chunk int, bucket int, totals binary, logs binary, n_all long, n_types long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers with their first bytes together, then their second bytes, and so on."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _sorted_planes(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _sorted_numbers(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes, np.uint64), dtype=np.uint64)


def _word_bucket(words: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _gram_bucket(grams: np.ndarray, n_buckets: int) -> np.ndarray:
    return _word_bucket(mix64((grams >> np.uint64(8)) & np.uint64(0xFFFFFF)), n_buckets)


def _pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for whole in table.to_batches():
        yield from slices(whole, "text", SLICE)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, firsts = hash_words(*table_bytes(texts), lower=True)
    return hashes, firsts


def _chunk_counts(table: pa.Table, order: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The distinct words and the distinct windows of a chunk, each with their counts in its training texts."""
    parts = [[(np.zeros(0, np.uint64), np.zeros(0, np.int64))] for _ in range(2)]
    for batch in _pieces(table):
        texts = batch.column(batch.schema.get_field_index("text"))
        trains = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
        for part, (keys, firsts) in zip(parts, (_words(texts), windows(*table_bytes(texts), order)), strict=True):
            gathered(part, merged(keys, np.repeat(trains, np.diff(firsts)).astype(np.int64)))
    words, grams = map(joined, parts)
    return words, grams


def _widths(n_buckets: int, fan: int) -> list[int]:
    """How many buckets of the last level each level takes as one."""
    widths = [1]
    while widths[0] * fan < n_buckets:
        widths.insert(0, widths[0] * fan)
    return widths


def _by_bucket(grams: np.ndarray, n_buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted windows bucket by bucket, and their buckets in that order."""
    buckets = _gram_bucket(grams, n_buckets) // width
    order = np.argsort(buckets, kind="stable")
    return order, buckets[order]


def _asked(chunk: int, words: np.ndarray, word_counts: np.ndarray, grams: np.ndarray, counts: np.ndarray, n_buckets: int, width: int) -> pa.Table:
    """Sorted words and windows with their counts as one row for each bucket."""
    at, buckets = _by_bucket(grams, n_buckets, width)
    grams, counts = grams[at], counts[at]
    word_buckets = _word_bucket(words, n_buckets) // width
    rows = []
    for k in np.union1d(word_buckets, buckets).tolist():
        w, g = (slice(*np.searchsorted(x, [k, k + 1]).tolist()) for x in (word_buckets, buckets))
        rows.append((chunk, k, _sorted_planes(words[w]), _planes(word_counts[w]), _sorted_planes(grams[g]), _planes(counts[g])))
    return _rows(rows, QUESTIONS)


def questions(table: pa.Table, order: int, n_buckets: int, width: int) -> pa.Table:
    """What a chunk asks of each bucket."""
    words, grams = _chunk_counts(table, order)
    release()
    return _asked(table.column("chunk")[0].as_py(), *words, *grams, n_buckets, width)


def summed(table: pa.Table, fan: int, n_buckets: int, width: int) -> pa.Table:
    """What ``fan`` chunks, or groups of them, ask of one bucket, as one group's questions to the narrower buckets in it."""
    *words, _ = _totals(*_columns(table, "words", "word_counts"))
    *grams, _ = _totals(*_columns(table, "grams", "gram_counts"))
    return _asked(table.column("chunk")[0].as_py() // fan, *words, *grams, n_buckets, width)


def _columns(table: pa.Table, keys: str, counts: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [_sorted_numbers(p) for p in table.column(keys).to_pylist()], [_numbers(p, np.int64) for p in table.column(counts).to_pylist()]


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the place of each given key among them."""
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64), at


def _answered(table: pa.Table, words: list[np.ndarray], grams: list[np.ndarray], totals: np.ndarray, logs: np.ndarray, sums: tuple[int, int] = (0, 0)) -> pa.Table:
    """Totals and logs, which follow the words and windows of the questions one by one, as one row for each question; the sums stand in the first."""
    rows, w, g = [], 0, 0
    for k, (chunk, bucket) in enumerate(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True)):
        mine, theirs = slice(w, w + len(words[k])), slice(g, g + len(grams[k]))
        w, g = mine.stop, theirs.stop
        rows.append((chunk, bucket, _planes(totals[mine]), logs[theirs].tobytes(), *(sums if k == 0 else (0, 0))))
    return _rows(rows, ANSWERS)


def answers(table: pa.Table, short: Model, order: int) -> pa.Table:
    """What a bucket answers to each chunk."""
    words, word_counts = _columns(table, "words", "word_counts")
    grams, counts = _columns(table, "grams", "gram_counts")
    _, word_totals, word_at = _totals(words, word_counts)
    unique, gram_totals, gram_at = _totals(grams, counts)
    seen = gram_totals > 0
    long = [level_tables(unique[seen], gram_totals[seen], k) for k in range(short.order + 1, order + 1)]
    model = Model(order, [*short.grams, *(g for g, _ in long)], [*short.contexts, *(c for _, c in long)])
    logs = model.log10(unique).astype(np.float32)[gram_at]
    return _answered(table, words, grams, word_totals[word_at], logs, (int(word_totals.sum()), int((word_totals > 0).sum())))


def _received(given: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The totals and the logs of all buckets in the order of buckets."""
    given = given.sort_by("bucket")
    return np.concatenate([_numbers(p, np.int64) for p in given.column("totals").to_pylist()]), np.concatenate([np.frombuffer(p, np.float32) for p in given.column("logs").to_pylist()])


def handed_on(table: pa.Table, given: pa.Table, n_buckets: int, width: int) -> pa.Table:
    """Answers to a group from the narrower buckets, as answers of one bucket to each of those in the group."""
    words, grams = (_columns(table, *c)[0] for c in (("words", "word_counts"), ("grams", "gram_counts")))
    totals, in_buckets = _received(given)
    unique, gram_at = np.unique(np.concatenate(grams), return_inverse=True)
    logs = np.zeros(len(unique), np.float32)
    logs[_by_bucket(unique, n_buckets, width)[0]] = in_buckets
    # words are in the order of buckets as they are
    return _answered(table, words, grams, totals[np.unique(np.concatenate(words), return_inverse=True)[1]], logs[gram_at])


def _answers(asked: DataFrame, shared: Broadcast, order: int, n_chunks: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Answers to all chunks, and those of the last level, which hold the sums over all words."""

    def sums_at(width: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: summed(table, fan, n_chunks, width)

    def answers_at(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda table, given: handed_on(table, given, n_chunks, width)

    widths = _widths(n_chunks, fan)
    levels = [asked]
    for width in widths[1:]:
        levels[-1] = staged(levels[-1], "lm-questions")
        meet = levels[-1].withColumn("group", F.floor(F.col("chunk") / fan))
        levels.append(meet.groupBy("group", "bucket").applyInArrow(released(sums_at(width)), QUESTIONS))
    last = answered = staged(levels[-1].groupBy("bucket").applyInArrow(released(lambda table: answers(table, shared.value, order)), ANSWERS), "lm-answers")
    for level, width in zip(levels[-2::-1], widths[:0:-1], strict=True):
        meet = level.withColumns({"group": F.floor(F.col("chunk") / fan), "wide": F.col("bucket").cast("long")})
        given = answered.withColumns({"group": F.col("chunk").cast("long"), "wide": F.floor(F.col("bucket") / fan)})
        answered = meet.groupBy("group", "wide").cogroup(given.groupBy("group", "wide")).applyInArrow(released_pair(answers_at(width)), ANSWERS)
    return answered, last


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    ship_package(docs.sparkSession)
    # what is returned runs later, so the bound stays in the session
    bound_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).withColumn("held_out", held_out())
    n_bytes, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    n_chunks = max(1, -(-n_bytes // chunk_bytes))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    low = min(order, SHORT - 1)
    training = rows.where(~F.col("held_out")).select(F.lit("all").alias("model"), F.coalesce("text", F.lit("")).alias("text"))
    models = model_of(staged(gram_counts(training, low), "lm-grams"), low)
    shared = docs.sparkSession.sparkContext.broadcast(models.get("all") or Model(low, *[[(np.zeros(0, np.uint64), np.zeros(0))] * (low + 1)] * 2))

    # a bucket holds about as many windows as a chunk, so there are as many of them
    width = _widths(n_chunks, fan)[0]
    asked = chunked.groupBy("chunk").applyInArrow(released(lambda table: questions(table, order, n_chunks, width)), QUESTIONS)
    answered, last = _answers(asked, shared, order, n_chunks, fan)
    known = last.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    n_all, n_types = known[0] + n_train, known[1] + (1 if n_train else 0)

    def evaluate(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        # words are in the order of buckets as they are; windows are brought back from it
        counts, logs = _received(given)
        parts, asked_for = [], []
        for batch in _pieces(table):
            texts = batch.column(batch.schema.get_field_index("text"))
            packed, starts = windows(*table_bytes(texts), order)
            unique, at = np.unique(packed, return_inverse=True)
            gathered(asked_for, (unique, np.zeros(len(unique), np.int8)))
            parts.append((batch, *_words(texts), unique, at.astype(np.int32), starts))
        keys = np.unique(np.concatenate([p[1] for p in parts]))
        grams = joined(asked_for)[0]
        values = np.zeros(len(grams))
        values[_by_bucket(grams, n_chunks, width)[0]] = logs
        base = np.log10((counts + 0.1) / (n_all + 0.1 * (n_types + 1)))
        end = float(np.log10((n_train + 0.1) / (n_all + 0.1 * (n_types + 1))))
        out = []
        for batch, hashes, firsts, unique, windows_at, starts in parts:
            at = np.searchsorted(keys, hashes)
            sums, seen = (np.concatenate([[0.0], np.cumsum(x)]) for x in (base[at], counts[at] > 0))
            out.append(
                pa.table(
                    {
                        "doc_id": batch.column(batch.schema.get_field_index("doc_id")),
                        "held_out": batch.column(batch.schema.get_field_index("held_out")),
                        "n_tokens": pa.array(np.diff(firsts) + 1),
                        "n_known": pa.array((seen[firsts[1:]] - seen[firsts[:-1]]).astype(np.int64) + (1 if n_train else 0)),
                        "train_tokens": pa.array(np.full(batch.num_rows, n_all, np.int64)),
                        "base_score": pa.array(sums[firsts[1:]] - sums[firsts[:-1]] + end),
                        "score": pa.array(np.add.reduceat(values[np.searchsorted(grams, unique)][windows_at], starts[:-1])),
                    }
                )
            )
        return pa.concat_tables(out)

    return chunked.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(released_pair(evaluate), SCORES)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(documents(spark, sf_dir))


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLES: dict[str, str] = {}
