"""The prefix trie against a trie of Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from revscope.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, piece string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in members:
        leaves = saved = 0
        todo = [node]
        while todo:
            x = todo.pop()
            todo += children[x]
            leaves += not children[x]
            if x:
                saved += (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1]))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_rows(seed, conversations, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, turns)):
            rows.append((c * rng.choice([1, 1, 1]), t, rng.choice(["user", "assistant"]) if texts > 2 else "user", " ".join([rng.choice("abcdef")] * rng.randint(0, 3)) if texts > 3 else "xyz"[rng.randrange(texts)]))
    return rows


@pytest.mark.parametrize(("seed", "conversations", "turns", "texts", "hot"), [(1, 60, 6, 2, 1000), (2, 90, 5, 1, 3), (3, 40, 9, 4, 1000), (4, 70, 4, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, conversations, turns, texts, hot):
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "RANGES", 7)
    rows = random_rows(seed, conversations, turns, texts)
    random.Random(seed).shuffle(rows)
    nodes = P.trie(table(spark, rows))
    assert got(nodes) == brute(rows)
    places = sorted((r.place, r.end, r.depth) for r in nodes.select("place", "end", "depth").collect())
    assert [p for p, _, _ in places] == list(range(len(places)))
    for place, end, depth in places:
        below = [d for p, _, d in places if place < p <= end]
        assert all(d > depth for d in below) and (end == len(places) - 1 or places[end + 1][2] <= depth)


def test_nulls_ties_and_negative_ids(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", "a b"), (5, 1, "user", "a b"), (5, 1, "user", "c"), (5, 1, "bot", "c"), (-3, 2, "user", " \t\n"), (-3, 0, None, "x"), (-20, 0, "user", "x y z"), (-25, 0, "user", "q"), (0, 3, "user", None), (0, 2, "user", "b"), (2, 0, "user", "only"), (26, 0, "user", "short"), (46, 7, "u", "v")]
    assert got(P.trie(table(spark, rows))) == brute(rows)


def test_long_conversation_is_spread(spark):
    rows = [(20, t, "user", f"w{t}") for t in range(700)] + [(40, t, "user", f"w{t}") for t in range(650)] + [(60, t, "user", f"w{t if t < 300 else 9}") for t in range(500)] + [(c, 0, "user", "hi") for c in range(61, 75)]
    assert got(P.trie(table(spark, rows))) == brute(rows)
    turns = P._ordered(table(spark, rows))
    assert turns.where("conv = 20").select("piece").distinct().count() > 1


def test_every_prefix_is_a_conversation_of_its_own(spark):
    rows = [(20 * n, t, "user", f"w{t}" if t < n else f"end{n}") for n in range(1, 25) for t in range(n + 1)]
    assert got(P.trie(table(spark, rows))) == brute(rows)


def test_empty_and_unfit_tables(spark):
    assert P.trie(table(spark, [])).collect() == []
    assert P.trie(table(spark, [(None, 1, "user", "x")])).collect() == []


def test_turnless_conversations(spark):
    short = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert short and got(P.trie(table(spark, short))) == brute(short) and len(brute(short)) == 1


def test_a_collision_stops_the_job(spark):
    ends = spark.createDataFrame([(1, 7, 8), (2, 7, 8)], "conv long, a long, b long")
    paths = spark.createDataFrame([(1, 1, 7, 8, 0, 0, b"x", 1), (2, 1, 7, 8, 0, 0, b"y", 1)], "conv long, depth long, a long, b long, pa long, pb long, sha binary, words long")
    with pytest.raises(Exception, match="share a name"):
        P._nodes(paths, ends).collect()
