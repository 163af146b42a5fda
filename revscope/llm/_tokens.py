"""Whole texts to token ids with a byte-level BPE file of the tokenizers library.

Both installed libraries apply such a vocabulary with the same result: a merge's
rank is the id of what it makes. For texts of Latin letters the merges are left
to tiktoken, which needs a fifth of the CPU time (180 against 1000 seconds a GB);
texts with other characters, where the libraries' Unicode tables could differ,
texts with a special token's string, and texts with a very long run of white
space, which tiktoken's pattern cannot take, go to the tokenizers library itself.
A very long text goes through in parts, cut before a space that follows a letter
or a digit: a token of either library begins there whatever stands around it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

from revscope.llm.bpe import byte_symbols

_NOT_LATIN = re.compile("[^\x00-ɏ]")
#: Characters of a text, and of a run of white space, from which on they are long.
LONG_TEXT = 1 << 20
LONG_SPACE = 1 << 15
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
_encoders: dict[str, ByteLevelEncoder] = {}


def parts_of(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """A text in parts of about ``limit`` characters whose ids, one after the other, are the ids of the text."""
    begin = 0
    while len(text) - begin > limit:
        at = text.find(" ", begin + limit)
        while at > 0 and not text[at - 1].isalnum():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


class ByteLevelEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = json.loads(Path(path).read_text())["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        plain = not _NOT_LATIN.search(text) and not any(s in text for s in self.special)
        if plain and (len(text) < LONG_SPACE or not _LONG_SPACE.search(text)):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        return [b"".join([array("I", self._ids(part)).tobytes() for part in parts_of(text)]) for text in texts]


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
