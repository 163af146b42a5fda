"""What tasks of the similarity join hold at a time."""

import numpy as np

from revscope.llm import _common, jaccard


def test_repeats_are_counted_in_place():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (2, 1), (3, 2), (1000, 300), (4096, 10**6)):
        values = r.integers(0, top, n).astype(np.uint64)
        keys, counts = np.unique(values, return_counts=True)
        got = jaccard.repeats(values)
        assert (np.diff(values.view(np.int64)) >= 0).all() and got[0].tolist() == keys[counts > 1].tolist() and got[1].tolist() == counts[counts > 1].tolist()


def test_python_gets_small_batches_and_the_session_keeps_its_own(spark, monkeypatch):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(words[k] for k in r.integers(0, 5000, 300).tolist()) for _ in range(400)]
    texts += texts[:50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    arrow_map, limit = jaccard.arrow_map, 1 << 16

    def watched(df, fn, schema):
        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes < 2 * limit, batch.nbytes
                    yield batch

            yield from fn(seen())

        return arrow_map(df, run, schema)

    monkeypatch.setattr(jaccard, "arrow_map", watched)
    monkeypatch.setattr(_common, "BATCH_BYTES", limit, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r.doc_id: r.component_id for r in jaccard.components_of(docs).collect()}
    assert got == {k: k if k < 400 else k - 400 for k in range(450)} and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_parts_that_are_joined_as_they_come_hold_distinct_keys_only():
    from revscope.llm import ppm

    r = np.random.default_rng(2)
    parts, given = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], []
    for _ in range(40):
        part = ppm.merged(r.integers(0, 5000, 20000).astype(np.uint64), r.integers(0, 2, 20000))
        given.append(part)
        ppm.gathered(parts, part)
        assert sum(len(p[0]) for p in parts) <= 2 * 5000
    want = ppm.merged(*(np.concatenate(x) for x in zip(*given, strict=True)))
    got = ppm.joined(parts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert [len(x) for x in ppm.joined(parts[:0] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])] == [0, 0]


def test_workers_give_back_what_they_freed(spark):
    def held(batches):
        import re
        from pathlib import Path

        import pyarrow as pa

        for _ in batches:
            now = int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1))
            yield pa.RecordBatch.from_arrays([pa.array([now])], names=["kb"])

    def filled(batches):
        import builtins

        import pyarrow as pa

        for _ in batches:
            # small pieces below one that stays, so that the allocator keeps them
            pieces = [b"x" * 40_000 for _ in range(8000)]
            builtins.kept_piece = pieces[-1]
            del pieces
            yield pa.RecordBatch.from_arrays([pa.array([0])], names=["kb"])

    one = spark.range(1).coalesce(1)
    before = _common.arrow_map(one, held, "kb long").first().kb
    _common.arrow_map(one, filled, "kb long").collect()
    assert _common.arrow_map(one, held, "kb long").first().kb < before + 60_000
