"""Tables that are made to break things: thousands of labels, media that ask validators for endless work."""

import gzip
import random
import struct
import time
import zlib

import pytest

import corpus_pipeline
from revscope.llm import language_id, media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def labelled(spark, labels):
    rng = random.Random(4)
    texts = {"en": "the ing and ion her that".split(), "de": "und sch ei ung zu ge".split()}
    rows = []
    for i in range(600):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(texts[lang]) for _ in range(30))
        rows.append((i, text, lang, "s", len(text)))
    rows += [(1000 + i, f"dirty {i} words", f"label-{i:05}", "s", 14) for i in range(labels)]
    return spark.createDataFrame(rows, SCHEMA)


def test_many_labels_are_no_harm(spark):
    docs = labelled(spark, 5000)
    got = language_id.identify(docs).collect()
    assert len(got) == 5600
    known = [r for r in got if r.doc_id < 1000 and r.held_out]
    assert known and sum(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in known) >= 0.95 * len(known)
    assert corpus_pipeline.identified(spark, docs, "").count() == 5600


def test_rarer_labels_than_the_bound_teach_nothing(spark):
    docs = labelled(spark, 50)
    models = language_id.train(docs.select("doc_id", "text", "lang"), languages=2)
    assert sorted(models) == ["de", "en"]
    assert sorted(language_id.train(docs.where("doc_id >= 1000").select("doc_id", "text", "lang"), languages=3)) == ["label-00000", "label-00001", "label-00002"]


def _png_head():
    ihdr = b"IHDR" + b"x" * 13
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + ihdr + struct.pack(">I", zlib.crc32(ihdr)) + struct.pack(">I", 500_000) + b"IDAT"


_FRAME = b"\xff\xf8\x19\x00\x01" + bytes([media._crc(b"\xff\xf8\x19\x00\x01", 7, 8)])
HOSTILE = {
    "flac": b"fLaC\x80\0\0\x22" + bytes(34) + _FRAME,
    "png": _png_head(),
    "gif": b"GIF89a\1\0\1\0\0\0\0!\xf9\1",
    "jpeg": b"\xff\xd8\xff\xda\0\2a",
    "riff": b"RIFF\0\0\x08\0WAVEfmt \0\0\0\0",
    "pdf": b"%%EOF%PDF-1 obj",
    "zip": b"PK\3\4",
    "zip-directory": b"PK\3\4PK\1\2" + bytes(42),
    "ogg": b"OggS\0\0" + bytes(20) + b"\0",
    "gzip": b"\x1f\x8b\x08" + bytes(7) + b"\0\x10\0\xef\xff",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_validators_end_in_bounded_time(name):
    value = (HOSTILE[name] * ((1 << 20) // len(HOSTILE[name]) + 1))[: 1 << 20]
    began = time.perf_counter()
    assert media.inspect(value, media._automaton())[0] == media.UNKNOWN
    assert time.perf_counter() - began < 8


def test_one_header_before_many_frames():
    began = time.perf_counter()
    media.inspect(HOSTILE["flac"] + _FRAME * 100_000, media._automaton())
    assert time.perf_counter() - began < 8


def test_inflation_is_bounded_by_the_size_of_the_value():
    assert media.inspect(gzip.compress(bytes(300 << 20)), media._automaton()) == (media.UNKNOWN, [])
    assert media.inspect(gzip.compress(random.Random(1).randbytes(3 << 20)), media._automaton())[0] == "application/gzip"


def _flac_by_definition(b, at):
    """Frames read one after the other, every checksum computed anew."""
    i, end = at + 42, 0
    while header := media._flac_frame(b, i):
        for stop in range(i + header + 1, len(b) + 1):
            if (stop == len(b) or media._flac_frame(b, stop)) and media._crc(b[i : stop - 2], 0x8005, 16) == int.from_bytes(b[stop - 2 : stop], "big"):
                break
        else:
            break
        i = end = stop
    return end and end - at


def test_frames_found_by_sums_are_the_frames_found_by_checksums():
    rng = random.Random(8)
    for _ in range(300):
        b = b"fLaC\x80\0\0\x22" + bytes(34)
        for _ in range(rng.randint(0, 4)):
            frame = b"\xff\xf8\x19\x00" + bytes([rng.randrange(128)])
            frame += bytes([media._crc(frame, 7, 8)]) + rng.randbytes(rng.randint(0, 20))
            b += frame + media._crc(frame, 0x8005, 16).to_bytes(2, "big")
        if rng.random() < 0.5:
            b = b[: len(b) - rng.randint(0, 4)] + rng.randbytes(rng.randint(0, 3))
        assert media._flac(b, 0) == _flac_by_definition(b, 0)
