from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from revscope.llm import language_id
from tests.llm import fixtures
from tests.llm.test_operators import brute_components, brute_repeats


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    fixtures.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    have = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert docs.columns == columns
        if name == "language_id":
            have = {i: t for i, t in have.items() if t and language_id._LETTER.search(t)}
        elif name == "jaccard_join":
            have = {i: have[i] for i, (_, c) in brute_components(have).items() if c == i}
        elif name == "substring_dedup":
            have = {i: kept if gone else have[i] for i, (_, gone, kept) in brute_repeats(have, 50).items()}
        if k < 3:
            assert {r.doc_id: r.text for r in docs.collect()} == have
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} == set(have)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, own in docs.toPandas().groupby("doc_id"):
        ids = b"".join(own.sort_values("piece")["ids"])
        assert ids == np.array([*library.encode(have[i], add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_on(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_no_row_vanishes_but_by_the_rule_of_its_stage(spark, tmp_path):
    fresh = [f"{w} stands in this text alone {k}" for k, w in enumerate(["first", "second", "third", "fourth"])]
    copy = "the same words stand in all of these rows"
    rows = [(None, fresh[0]), (None, fresh[1]), (7, fresh[2]), (7, fresh[3]), (7, copy), (7, copy), (None, copy), (9, copy), (None, None), (8, "12 34"), (8, "")]
    out = run_on(spark, tmp_path, [(i, t, "en", "s", len(t) if t else None) for i, t in rows])
    # four texts of their own, two of them without an id, and one row of the copies, the one with the smallest id
    assert Counter(r.doc_id for r in out) == Counter({None: 2, 7: 3})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(library.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist()) for r in out) == sorted([*fresh, copy])


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == []
