"""Very long texts through all ten queries and the pipeline: runs of white space, one huge word, one huge line."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from revscope.llm import registry
from revscope.llm._tokens import parts_of

MILLION = 1_000_000
TEXTS = {
    0: " " * MILLION,
    1: " \n" * (MILLION // 2) + "end",
    2: "abcdefgh" * (MILLION // 8),
    3: "the cat sat on a mat " * (MILLION // 21),
    4: "a short text",
    100: " " * (5 * MILLION),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 60, 5)], "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


def test_every_query_has_its_columns():
    assert registry.queries().keys() == COLUMNS.keys()


@pytest.mark.parametrize("name", COLUMNS)
def test_query_takes_very_long_texts(spark, folder, name):
    out = registry.queries()[name](spark, folder)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == COLUMNS[name]
    rows = out.collect()
    if name == "op3_top_k":
        assert {r.query_id for r in rows} == {0, 20, 40} and len(rows) == 33
        return
    assert {r.doc_id for r in rows} == set(TEXTS)
    if name == "op1_sharding":
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
        assert all(r.size == len(TEXTS[r.doc_id]) + 1 for r in rows)
    if name == "op2_bpe":
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        for r in rows:
            assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    if name in ("op4_token_files", "op10_packing"):
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        for i in set(TEXTS) - {100}:
            ids = np.array([*library.encode(TEXTS[i], add_special_tokens=False).ids, 2 if name == "op4_token_files" else 0], "<u4").tobytes()
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert [r.ids_crc32 for r in own] == ([zlib.crc32(ids)] if name == "op4_token_files" else [zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own])
    if name == "op6_substring_dedup":
        assert all(r.n_removed == 0 for r in rows)


def test_pipeline_takes_very_long_texts(spark, folder):
    out = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4}


def test_parts_are_the_text_and_begin_at_spaces():
    text = "ab c, d  e1 f\n" * 50
    parts = list(parts_of(text, 20))
    assert "".join(parts) == text and len(parts) > 20 and all(p[0] == " " for p in parts[1:])
    assert list(parts_of(" " * 50, 20)) == [" " * 50]
