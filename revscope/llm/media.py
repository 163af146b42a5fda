"""Media columns: store samples as WAV, find out by signature what bytes really are, and carve what they embed.

An Aho-Corasick automaton locates the magic bytes of all known formats in one
pass; a validator per format then walks its structure and lengths, so that a
chance match of a few bytes is not taken for media. The type that a validator
confirms at the start of a value corrects the declared type.

Defined results: a null value has no type and embeds nothing; an empty value or
one that no validator confirms is ``application/octet-stream``; equal values get
equal results; extra columns are kept by ``sniff`` and dropped by ``encode_wav``. Very long values are
read whole. Validators of one value share what they find out, so that no position is walked
from twice, and together read at most 64 times its bytes: where hostile values ask for
more, the signatures behind stay unconfirmed.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, documents, keyed, slices, staged

UNKNOWN = "application/octet-stream"
BLOCK = 576
RATE = 8000
SLICE = 4 << 20


#: A validator may read this many times a value's bytes (a step of its own counts as STEP bytes) before what is left of the
#: value's signatures stays unconfirmed: honest media need one pass for each level of nesting.
PASSES, STEP, LEAST_WORK = 64, 64, 1 << 20


class Notes:
    """What validators found out about a value: where walks from a position end, and how much work is left."""

    def __init__(self, b: bytes):
        self.left = PASSES * len(b) + LEAST_WORK
        self.ends: dict[str, dict[int, int]] = {}
        self.directories: list[int] | None = None
        self.frames: Frames | None = None

    def spend(self, work: int) -> bool:
        self.left -= work
        return self.left >= 0


class Value(bytes):
    """A value with notes, which all its validators share."""

    notes: Notes


def _notes(b: bytes) -> Notes:
    return b.notes if isinstance(b, Value) else Notes(b)


def _walk(b: bytes, notes: Notes, name: str, i: int, step: Callable[[int], tuple[int, int]]) -> int:
    """Where the walk from ``i`` ends (0: nowhere). ``step`` gives the next position, or -1 and the end; no position is walked from twice."""
    ends, path, end = notes.ends.setdefault(name, {}), [], 0
    while True:
        if i in ends:
            end = ends[i]
            break
        path.append(i)
        if not notes.spend(STEP):
            break
        i, end = step(i)
        if i < 0:
            break
    ends.update(dict.fromkeys(path, end))
    return end


def _length(end: int, at: int) -> int:
    return end - at if end else 0


def _png(b: bytes, at: int) -> int:
    notes = _notes(b)

    def chunk(i: int) -> tuple[int, int]:
        end = i + 12 + int.from_bytes(b[i : i + 4], "big")
        if end > len(b) or not notes.spend(end - i) or zlib.crc32(b[i + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return -1, 0
        return (-1, end) if b[i + 4 : i + 8] == b"IEND" else (end, 0)

    return _length(_walk(b, notes, "png", at + 8, chunk), at)


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    notes = _notes(b)

    def data(i: int) -> tuple[int, int]:
        return (-1, 0) if i >= len(b) else (i + b[i] + 1, 0) if b[i] else (-1, i)

    def block(i: int) -> tuple[int, int]:
        kind = b[i] if i < len(b) else 0
        if kind == 0x3B:
            return -1, i + 1
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 <= len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
        else:
            return -1, 0
        end = _walk(b, notes, "gif-data", i, data)
        return (end + 1, 0) if end else (-1, 0)

    table = 3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0
    return _length(_walk(b, notes, "gif", at + 13 + table, block), at)


def _jpeg(b: bytes, at: int) -> int:
    notes = _notes(b)

    def scanned(i: int) -> tuple[int, int]:
        """Coded data up to a marker that is neither stuffed nor a restart; its place as the end, or a negative end behind the last marker."""
        j = b.find(b"\xff", i)
        if j < 0 or j + 1 >= len(b):
            return -1, 0
        if b[j + 1] == 0xD9:
            return -1, -(j + 2)
        if b[j + 1] not in (0, 0xFF, *range(0xD0, 0xD8)):
            return -1, j
        return (j + 2 if b[j + 1] != 0xFF else j + 1), 0

    def segment(i: int) -> tuple[int, int]:
        if i + 4 > len(b) or b[i] != 0xFF or (size := int.from_bytes(b[i + 2 : i + 4], "big")) < 2:
            return -1, 0
        if b[i + 1] != 0xDA:
            return i + 2 + size, 0
        end = _walk(b, notes, "jpeg-data", i + 2 + size, scanned)
        return (end, 0) if end > 0 else (-1, -end)

    return _length(_walk(b, notes, "jpeg", at + 2, segment), at)


def _riff(b: bytes, at: int, kind: bytes, first: bytes) -> int:
    if len(b) < at + 20 or b[at + 8 : at + 12] != kind or not b[at + 12 : at + 16].startswith(first):
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return 0
    i, notes = at + 12, _notes(b)
    while i + 8 <= end and notes.spend(STEP):
        i += 8 + (size := int.from_bytes(b[i + 4 : i + 8], "little")) + (size & 1)
    return end - at if i in (end, end + 1) else 0


def _wav(b: bytes, at: int) -> int:
    return _riff(b, at, b"WAVE", b"fmt ")


def _webp(b: bytes, at: int) -> int:
    return _riff(b, at, b"WEBP", b"VP8")


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    fits = header in (40, 52, 56, 108, 124) and spare == 0 and 14 + header <= start <= size
    return size if fits and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and at + size <= len(b) else 0


def _pdf(b: bytes, at: int) -> int:
    """Up to the last end mark (a file that was updated has several) before the next document."""
    after = b.find(b"%PDF-", at + 5)
    stop = len(b) if after < 0 else after
    end = b.rfind(b"%%EOF", at, stop)
    if not b[at + 5 : at + 6].isdigit() or end < 0 or b.find(b" obj", at, end) < 0:
        return 0
    place = re.search(rb"startxref\s+(\d+)\s+$", b[max(at, end - 64) : end])
    return end + 5 - at if place and int(place[1]) < end - at else 0


def _gzip(b: bytes, at: int) -> int:
    """One member, inflated to its end: its own checksum and length are confirmed on the way."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    inflate, notes, read = zlib.decompressobj(31), _notes(b), at
    try:
        while not inflate.eof:
            piece = inflate.unconsumed_tail or b[read : read + (1 << 14)]
            read = read if inflate.unconsumed_tail else read + len(piece)
            out = inflate.decompress(piece, 1 << 18)
            if not notes.spend(STEP + len(out) + len(piece) - len(inflate.unconsumed_tail)) or not (piece or out):
                return 0
        return read - len(inflate.unused_data) - at
    except zlib.error:
        return 0


def _zip(b: bytes, at: int) -> int:
    """The directory at the end must list its entries one after the other, and each must be where it says."""
    notes = _notes(b)
    if notes.directories is None:
        notes.directories = [m.start() for m in re.finditer(rb"PK\x05\x06", b)]
    nth = bisect.bisect_left(notes.directories, at)
    end = notes.directories[nth] if nth < len(notes.directories) else -1
    if end < 0 or end + 22 > len(b):
        return 0
    entries, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
    if at + start + size != end or end + 22 + note > len(b):
        return 0
    i = at + start
    for _ in range(entries):
        if b[i : i + 4] != b"PK\x01\x02" or i + 46 > end or not notes.spend(STEP):
            return 0
        name, extra, comment = struct.unpack_from("<HHH", b, i + 28)
        own = at + struct.unpack_from("<I", b, i + 42)[0]
        if own >= at + start or b[own : own + 4] != b"PK\x03\x04":
            return 0
        i += 46 + name + extra + comment
    return end + 22 + note - at if i == end else 0


@functools.cache
def _crc_table(poly: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        out = byte << (bits - 8)
        for _ in range(8):
            out = ((out << 1) ^ (poly if out >> (bits - 1) else 0)) & ((1 << bits) - 1)
        table.append(out)
    return table


def _crc(data: bytes, poly: int, bits: int) -> int:
    out, table, mask = 0, _crc_table(poly, bits), (1 << bits) - 1
    for byte in data:
        out = (out << 8 & mask) ^ table[out >> (bits - 8) ^ byte]
    return out


def _flac_frame(b: bytes, i: int) -> int:
    """The length of a frame's header whose checksum holds, else 0."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8:
        return 0
    size, rate = b[i + 2] >> 4, b[i + 2] & 15
    lead = b[i + 4]
    number = 1 if lead < 0x80 else next((n for n in range(2, 8) if (lead << n) & 0xFF < 0x80), 0)
    n = 4 + number + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not number or not size or rate == 15 or i + n >= len(b):
        return 0
    return n + 1 if _crc(b[i : i + n], 7, 8) == b[i + n] else 0


@functools.cache
def _powers() -> np.ndarray:
    """The powers of x modulo the polynomial of a frame's checksum, up to where they repeat."""
    out, power = [], 1
    while not out or power != 1:
        out.append(power)
        power = ((power << 1) ^ (0x18005 if power >> 15 else 0)) & 0xFFFF
    return np.array(out, np.uint16)


class Frames:
    """Where the frames of a value can begin, and where the checksum of the bytes between two places is zero.

    A checksum up to a place, divided by x to the power of the bits before it, differs between
    two places by a multiple of the checksum of what lies between: it is 0 where the two are equal.
    """

    def __init__(self, b: bytes):
        raw = np.frombuffer(b, np.uint8)
        powers = _powers()
        places = 16 - 8 * (np.arange(len(raw), dtype=np.int64) + 1)
        steps = np.zeros(len(raw) + 1, np.uint16)
        for bit in range(8):
            steps[1:] ^= np.where(raw >> bit & 1, powers[(places + bit) % len(powers)], 0).astype(np.uint16)
        self.sums = np.bitwise_xor.accumulate(steps)
        self.size = len(b)
        maybe = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8)).tolist()
        self.headers = {i: n for i in maybe if (n := _flac_frame(b, i))}
        self.equal: dict[int, list[int]] = {}
        for i in self.headers:
            self.equal.setdefault(int(self.sums[i]), []).append(i)

    def next(self, i: int) -> tuple[int, int]:
        """The end of the frame at ``i``: the first later frame, or the value's end, up to which its checksum holds; without one, ``i`` itself ends the walk."""
        if i not in self.headers:
            return -1, i
        later = self.equal[int(self.sums[i])]
        nth = bisect.bisect_right(later, i + self.headers[i])
        if nth < len(later):
            return later[nth], 0
        return -1, self.size if self.sums[self.size] == self.sums[i] else i


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks to the last one, then frames: a frame ends where its checksum holds before the next frame or the end of the value."""
    notes = _notes(b)

    def metadata(i: int) -> tuple[int, int]:
        if i + 4 > len(b) or b[i] & 0x7F in (0, 127):
            return -1, 0
        end = i + 4 + int.from_bytes(b[i + 1 : i + 4], "big")
        return (-1, end) if b[i] >> 7 else (end, 0)

    if b[at + 5 : at + 8] != b"\0\0\x22" or b[at + 4 : at + 5] not in (b"\0", b"\x80"):
        return 0
    first = at + 42
    if not b[at + 4]:
        first = _walk(b, notes, "flac-metadata", first, metadata)
    if not first or first >= len(b):
        return 0
    notes.frames = notes.frames or Frames(b)
    end = _walk(b, notes, "flac", first, notes.frames.next)
    return end - at if end > first else 0


def _ogg(b: bytes, at: int) -> int:
    def page(i: int) -> tuple[int, int]:
        if b[i : i + 4] != b"OggS" or i + 27 > len(b) or b[i + 4] != 0:
            return -1, 0
        laced = b[i + 27 : i + 27 + b[i + 26]]
        end = i + 27 + b[i + 26] + sum(laced)
        if len(laced) < b[i + 26] or end > len(b):
            return -1, 0
        return (-1, end) if b[i + 5] & 4 else (end, 0)

    return _length(_walk(b, _notes(b), "ogg", at, page), at)


#: The signatures that the formats' public specifications name.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
]


def _automaton() -> ahocorasick.Automaton:
    found: dict[bytes, list[tuple[str, Callable[[bytes, int], int]]]] = {}
    for magic, kind, check in SIGNATURES:
        found.setdefault(magic, []).append((kind, check))
    out = ahocorasick.Automaton()
    for magic, checks in found.items():
        out.add_word(magic.decode("latin-1"), (len(magic), checks))
    out.make_automaton()
    return out


def inspect(value: bytes, automaton: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]]]:
    """The confirmed type of a value, and the (type, offset, length) of the media embedded in it, outermost first.

    Embedded media never overlap one another: the match that starts first wins.
    """
    kind, inner, free = UNKNOWN, [], 0
    value = Value(value)
    value.notes = Notes(value)
    for last, (size, checks) in automaton.iter(value.decode("latin-1")):
        at = last - size + 1
        if at and at < free:
            continue
        for name, check in checks:
            if length := check(value, at):
                if at == 0:
                    kind = name
                else:
                    inner.append((name, at, length))
                    free = at + length
                break
    return kind, inner


SNIFFED = "type string, corrected boolean, embedded array<struct<type:string,offset:long,length:long>>"


def sniff(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """Add ``type``, ``corrected`` (the declared type was another) and ``embedded`` to every row.

    The three names replace columns of the same names.
    """
    kept = df.drop("type", "corrected", "embedded")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            types, wrong, inner = [], [], []
            for media, declared in zip(batch.column(names.index(media_col)), batch.column(names.index(declared_col)), strict=True):
                kind, found = (None, []) if (b := media.as_py()) is None else inspect(b, automaton)
                types.append(kind)
                wrong.append(None if kind is None else kind != declared.as_py())
                inner.append([{"type": t, "offset": o, "length": n} for t, o, n in found])
            kind_of = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inner, kind_of)], names=[*names, "type", "corrected", "embedded"])

    return arrow_map(kept, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + SNIFFED)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit samples of one channel as a WAV file (odd sizes get the pad byte that RIFF asks for)."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def samples_of(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(media):
        size = int.from_bytes(media[i + 4 : i + 8], "little")
        if media[i : i + 4] == b"data":
            return media[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def encode_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Store each whole text (null: empty) as 8-bit samples, padded with 255 to a positive multiple of ``block``.

    ``declared`` is what a producer that trusts file names would state: it
    follows from the text alone and is often wrong, as in crawled media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims = ["audio/wav", "image/png", UNKNOWN]
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sizes, media, declared = [], [], []
                for text in batch.column(1):
                    raw = (text.as_py() or "").encode()
                    sizes.append(len(raw))
                    media.append(wav(raw + b"\xff" * (block - len(raw) % block if len(raw) % block or not raw else 0)))
                    declared.append(claims[zlib.crc32(raw) % 3])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return arrow_map(keyed(docs, id_col, text_col), run, "doc_id long, n_bytes long, declared string, media binary")


def digest(media: DataFrame) -> DataFrame:
    """Read stored samples back and describe them. Needs the columns that ``sniff`` adds to ``encode_wav``'s."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for doc, size, declared, stored, kind, inner in zip(*(col[n] for n in ("doc_id", "n_bytes", "declared", "media", "type", "embedded")), strict=True):
                b = stored.as_py()
                payload = samples_of(b)
                levels = np.frombuffer(payload, np.uint8)
                mean = int(levels.sum(dtype=np.int64)) / len(levels)
                crossings = int(np.count_nonzero(np.diff(levels >= 128)))
                carved = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in inner.as_py())
                feature = f"type={kind};declared={declared};samples={len(levels)};mean={mean:.4f};crossings={crossings};embedded=[{carved}]"
                out.append((doc.as_py(), size.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)], names=[n for n, _ in fields])

    return arrow_map(media.select("doc_id", "n_bytes", "declared", "media", "type", "embedded"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored WAV columns, sniffed and read back."""
    stored = staged(encode_wav(documents(spark, sf_dir)), "media")
    return digest(sniff(stored))


QUERIES = {"op8_media_columns": op8_media_columns}
ORACLES: dict[str, str] = {}
