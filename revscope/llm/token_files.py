"""Token-id files coded with a static range asymmetric numeral system (rANS).

A file holds the ids of a range of documents in ascending doc_id order. All its
blocks share one frequency table, counted over the whole file. A block is coded
independently of the others, as many interleaved streams that are decoded in
step; it carries checkpoints (the decoder's states and its place in the code
words, every so many steps), from which parts of a block can be decoded in
parallel, and checksums of the code words and of the ids. Documents never cross
a block.

A file is one Parquet part: a row per block. Each row repeats the file's table,
compressed to a few hundredths of a block, so that any block is decoded from its
own row and reading needs no join. Spark commits the parts, so a lost executor
leaves no half file and any store that Spark can write holds them.

Defined results: a null text is empty and so holds the end id alone; null ids
come first; repeated rows are written each; an empty table gives files without
blocks. Extra columns are dropped.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import scratch_dir
from revscope.llm._common import arrow_map, documents, keyed, slices
from revscope.llm._tokens import byte_vocabulary, encoder
from revscope.llm.sharding import range_of, splitters
from revscope.operators.order import with_running_sums

END_ID = 2
SLICE = 2 << 20
BLOCK_TOKENS = 1 << 19
LANES = 1024
CHECKPOINT_STEPS = 256
SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LOWEST = -(2**63)


class Table:
    """Frequencies that sum to 2**SCALE; every id that occurs has at least one."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids, freqs
        self.starts = np.cumsum(freqs) - freqs

    @staticmethod
    def counted(tokens: np.ndarray) -> Table:
        counts = np.bincount(tokens)
        ids = np.flatnonzero(counts)
        total = 1 << SCALE
        if len(ids) > total:
            raise ValueError(f"more than {total} different ids in a file")
        counts = counts[ids]
        freqs = np.maximum(1, counts * total // max(1, counts.sum()))
        spare = total - int(freqs.sum())
        order = np.argsort(-counts, kind="stable")
        if spare >= 0:
            freqs[order[:1]] += spare
        for i in order:
            if spare >= 0:
                break
            take = min(-spare, int(freqs[i]) - 1)
            freqs[i] -= take
            spare += take
        return Table(ids.astype(np.int64), freqs.astype(np.int64))

    def packed(self) -> bytes:
        dense = np.zeros(int(self.ids[-1]) + 1, "<u4")
        dense[self.ids] = self.freqs
        return zlib.compress(dense.tobytes(), 6)

    @staticmethod
    def unpacked(raw: bytes) -> Table:
        dense = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        ids = np.flatnonzero(dense)
        return Table(ids, dense[ids])

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.freqs)


def encode_block(tokens: np.ndarray, table: Table, lanes: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Code words, and per checkpoint the states (a row of lanes) and the number of words read before it."""
    steps = -(-len(tokens) // lanes)
    at = np.searchsorted(table.ids, tokens)
    at = np.concatenate([at, np.zeros(steps * lanes - len(tokens), at.dtype)]).reshape(steps, lanes)
    freq, start = table.freqs.astype(np.uint64), table.starts.astype(np.uint64)
    x = np.full(lanes, LOW)
    words, states, counts = [], [], []
    limit = np.uint64(31 - SCALE + 32)
    for step in range(steps - 1, -1, -1):
        f, c = freq[at[step]], start[at[step]]
        full = x >= (f << limit)
        out = x[full]
        words.append(out.astype("<u4"))
        x[full] = out >> WORD
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        counts.append(len(out))
        if step % CHECKPOINT_STEPS == 0:
            states.append(x.copy())
    read = np.concatenate([[0], np.cumsum(counts[::-1])]).astype(np.int64)
    code = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return code.tobytes(), np.array(states[::-1]), read[:-1:CHECKPOINT_STEPS] if steps else read[:0]


def decode_block(code: bytes, states: np.ndarray, read: np.ndarray, n_tokens: int, table: Table, slots: np.ndarray, first: int = 0) -> np.ndarray:
    """The ids of a block from its checkpoint ``first`` on."""
    lanes = states.shape[1]
    steps = -(-n_tokens // lanes)
    words = np.frombuffer(code, "<u4").astype(np.uint64)
    freq, start = table.freqs.astype(np.uint64), table.starts.astype(np.uint64)
    x, place, begin = states[first].astype(np.uint64), int(read[first]), first * CHECKPOINT_STEPS
    out = np.empty((steps - begin, lanes), dtype=np.int64)
    mask = np.uint64((1 << SCALE) - 1)
    for step in range(steps - begin):
        low = x & mask
        s = slots[low]
        out[step] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + low - start[s]
        empty = np.flatnonzero(x < LOW)
        x[empty] = (x[empty] << WORD) | words[place : place + len(empty)]
        place += len(empty)
    return table.ids[out.reshape(-1)[: n_tokens - begin * lanes]]


BLOCKS = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("code", pa.binary()), ("code_crc32", pa.int64()), ("ids_crc32", pa.int64()),
        ("states", pa.binary()), ("read", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("table", pa.binary()),
    ]
)
BLOCKS_DDL = "part int, block int, first_token long, n_tokens long, lanes int, code binary, code_crc32 long, ids_crc32 long, states binary, read array<long>, doc_ids array<long>, doc_tokens array<long>, table binary"


def _file_rows(part: int, docs: list[int | None], tokens: list[np.ndarray]) -> Iterator[dict]:
    """The blocks of one file, from its documents in order."""
    table = Table.counted(np.concatenate(tokens))
    packed = table.packed()
    first, block, i = 0, 0, 0
    while i < len(docs):
        j, size = i, 0
        while j < len(docs) and (j == i or size + len(tokens[j]) <= BLOCK_TOKENS):
            size += len(tokens[j])
            j += 1
        ids = np.concatenate(tokens[i:j])
        lanes = max(1, min(LANES, size // CHECKPOINT_STEPS))
        code, states, read = encode_block(ids, table, lanes)
        yield {
            "part": part, "block": block, "first_token": first, "n_tokens": size, "lanes": lanes, "code": code, "code_crc32": zlib.crc32(code), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
            "states": states.astype("<u8").tobytes(), "read": read.tolist(), "doc_ids": docs[i:j], "doc_tokens": [len(t) for t in tokens[i:j]], "table": packed,
        }
        first, block, i = first + size, block + 1, j


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 24 << 20) -> None:
    """Encode whole texts and write their ids, each document's end id included, in ascending doc_id order.

    Documents are dealt to files by ranges of (doc_id, hash of the text), cut at
    sampled splitters so that a file holds about ``part_bytes`` of text, also where
    an id is null or repeats.
    """
    vocabulary = vocabulary or byte_vocabulary()
    docs = keyed(docs, id_col, text_col)
    n_bytes, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_parts = max(1, min(-(-n_bytes // part_bytes), n_docs))
    keys = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("h"), F.xxhash64("text").alias("d"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    shared = docs.sparkSession.sparkContext.broadcast(splitters(keys, n_parts))
    docs = docs.withColumn("d", F.xxhash64("text"))

    model = json.loads(Path(vocabulary).read_text())
    max_id = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    unit = "<u2" if max_id < 65536 else "<u4"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = batch.column(0)
                part = range_of(shared.value, ids.fill_null(LOWEST).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
                rows = [b + end for b in encode([t or "" for t in batch.column(1).to_pylist()])]
                narrow = [np.frombuffer(b, "<u4").astype("<u2").tobytes() if max_id < 65536 else b for b in rows]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pa.array(narrow, pa.binary()), batch.column(2)], names=["part", "doc_id", "ids", "d"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs_of, tokens = None, [], []
        for batch in batches:
            for p, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part and docs_of:
                    for row in _file_rows(part, docs_of, tokens):
                        yield pa.RecordBatch.from_pylist([row], schema=BLOCKS)
                    docs_of, tokens = [], []
                part = p
                docs_of.append(doc)
                tokens.append(np.frombuffer(ids.as_py(), unit))
        if docs_of:
            for row in _file_rows(part, docs_of, tokens):
                yield pa.RecordBatch.from_pylist([row], schema=BLOCKS)

    dealt = arrow_map(docs, tokenize, "part int, doc_id long, ids binary, d long").repartitionById(len(shared.value) + 1, "part")
    arrow_map(dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "d").drop("d"), write, BLOCKS_DDL).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: per document doc_id, start (ids of all documents before it), n_tokens and ids.

    Every block is checked against its checksums; a damaged one is an error.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a file, summed range by range: the driver sees one row a range
    starts = with_running_sums(sizes, ["part"], {"tokens_before": "n"}).select("part", "tokens_before")
    joined = blocks.join(starts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, slots = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["part"]:
                    held, table = row["part"], Table.unpacked(row["table"])
                    slots = table.slots()
                if zlib.crc32(row["code"]) != row["code_crc32"]:
                    raise ValueError(f"damaged code in file {row['part']}, block {row['block']}")
                states = np.frombuffer(row["states"], "<u8").reshape(-1, row["lanes"])
                ids = decode_block(row["code"], states, np.array(row["read"]), row["n_tokens"], table, slots).astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"damaged ids in file {row['part']}, block {row['block']}")
                lengths = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(lengths)
                values = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = row["tokens_before"] + row["first_token"] + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(values, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    names = ["part", "block", "first_token", "n_tokens", "lanes", "code", "code_crc32", "ids_crc32", "states", "read", "doc_ids", "doc_tokens", "table", "tokens_before"]
    return arrow_map(joined.select(names), run, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    path = f"{scratch_dir(spark)}/revscope/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
