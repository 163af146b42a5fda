"""Small documents with the cases that every operator must take: nulls, empty and long texts, copies, near copies, clashing columns."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, part long, node long, label string, starts string, keys string, shard int, fill int, media string"
SYLLABLES = {"en": ["the", "ing", "and", "ion", "er", "th", "on"], "de": ["und", "sch", "ei", "ung", "zu", "ge"], "fr": ["que", "eau", "oi", "la", "tre", "é"]}


def word(rng: random.Random, lang: str) -> str:
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(word(rng, lang) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    texts: list[tuple[str | None, str | None]] = []
    passage = text(rng, "en", 70)
    base = text(rng, "en", 120)
    for i in range(90):
        lang = rng.choice(["en", "de", "fr"])
        t = text(rng, lang, rng.randint(1, 200))
        if i % 9 == 0:
            t = t + " " + passage + " " + text(rng, lang, 20)
        if i % 11 == 0:
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word(rng, "en")
            t = " ".join(words)
        texts.append((t, "en" if i % 11 == 0 else lang))
    texts += [(None, "en"), ("", "en"), ("   \n\t ", None), ("12345 67 !!", "de"), ("ΟΔΟΣ Straße 漢字 😀 é", "de"), ("one two three", "en"), ("a <|endoftext|> b", "en"), ("x" * 3000, "en")]
    texts += [(base, "en")] * 5 + [(passage, None)] * 2 + [(text(rng, "en", 3000), "en"), ("Upper CASE words Here five", "en"), ("upper case WORDS here FIVE", "en")]
    return [(i, t, lang, f"s{i % 3}", len(t) if t is not None else None, i, -i, None, i, "x", "y", None, 3, 4, "m") for i, (t, lang) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())
