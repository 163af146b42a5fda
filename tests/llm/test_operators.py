import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revscope.llm import bpe, jaccard, language_id, lm_score, media, packing, sharding, suffix_dedup, token_files, topk
from revscope.llm._common import hash_words, keyed, staged, table_bytes
from tests.llm import fixtures

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in fixtures.rows()}


def test_hash_words_are_words():
    import pyarrow as pa

    some = ["Hello  World foo\tBar\x0bé", "", None, "x", " lead trail "]
    raw, offsets = table_bytes(pa.array(some))
    _, starts, ends, firsts = hash_words(raw, offsets, True)
    found = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in some for w in WORDS.findall(t or "")]
    assert firsts.tolist() == np.concatenate([[0], np.cumsum([len(WORDS.findall(t or "")) for t in some])]).tolist()


# -- 1 sharding


def test_shards_are_even_and_gapless(docs, texts):
    plan = sharding.shard_plan(docs, 4, min_ranges=8).toPandas()
    assert sorted(plan.doc_id) == sorted(texts)
    for r in plan.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sums = plan.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * plan["size"].max()
    assert all(sorted(s) == list(range(len(s))) for _, s in plan.groupby("shard")["slot"])


def test_sharding_splits_one_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("copy " * 20).alias("text"))
    plan = sharding.shard_plan(rows, 16, min_ranges=32).toPandas()
    sums = plan.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 2 * plan["size"].max()


def test_write_shards_keeps_all_columns(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)


# -- 2 BPE


def test_bpe_equals_the_library(docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in bpe.digests(docs).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_of_tables(docs):
    encoded = bpe.encode(docs, decoded=True)
    again = bpe.decode(encoded).withColumnRenamed("decoded", "d2")
    assert encoded.join(again, "doc_id").where(~F.col("decoded").eqNullSafe(F.col("d2"))).count() == 0


def test_segment_tree_takes_leftmost_lowest_rank():
    tree = bpe.SegmentTreeBpe({c: i for i, c in enumerate(bpe.byte_symbols())} | {"aa": 256, "aaaa": 257}, [("a", "a"), ("aa", "aa")])
    ids = tree.encode_words([b"aaaaa", b"b", b"ab" * 40])
    assert ids[0].tolist() == [257, bpe.byte_symbols().index("a")] and len(ids[1]) == 1 and len(ids[2]) == 80


# -- 3 top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 17 == 5 else [float(x) for x in rng.normal(size=8)] if i % 13 else [1.0] * 8, "x") for i in range(400)]
    rows[7] = (7, [1.0, None] + [0.0] * 6, "x")
    rows[9] = (9, [float("nan")] * 8, "x")
    rows[11] = (11, [], "x")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, pair string").repartition(5)
    fit = {i: np.floor(64 * np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in fit:
        if q % 20 == 0:
            best = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q)[:20]
            want[q] = [(i, -s) for s, i in best]
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block=64, batch_bytes=600).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_stop_leaves_far_vectors_unscored():
    rng = np.random.default_rng(8)
    centres = np.eye(16) * 300
    rows = np.floor(np.concatenate([c + rng.normal(size=(500, 16)) * 4 for c in centres]))
    ids, share_scored = np.arange(len(rows)), []
    queries = np.floor(centres + rng.normal(size=(16, 16)) * 20)
    scores = queries @ rows.T
    for block in range(16):
        at = slice(500 * block, 500 * block + 500)
        floors = np.sort(scores, axis=1)[:, -20]
        lists = topk.Lists(ids[at], rows[at])
        q, v, s = lists.best(np.full(16, -1), queries, 20, floors)
        for i in range(16):
            want = sorted((-scores[i, j], j) for j in ids[at] if scores[i, j] >= floors[i])[:20]
            assert [(-a, b) for a, b in zip(s[q == i], v[q == i], strict=True)] == want
        share_scored.append(lists.scored / lists.pairs)
    assert np.mean(share_scored) < 0.1


def test_threshold_stop_reads_a_part_of_the_lists():
    rng = np.random.default_rng(9)
    rows = np.floor(rng.exponential(30, size=(4000, 3)))
    lists = topk.Lists(np.arange(4000), rows)
    query = np.array([[5.0, 3.0, -1.0]])
    scores = rows @ query[0]
    floor = np.sort(scores)[-20:][:1]
    q, v, s = lists.best(np.array([-1]), query, 20, floor)
    assert list(zip(-s, v, strict=True)) == sorted((-x, i) for i, x in enumerate(scores.tolist()))[:20]
    assert 0 < lists.scored < 0.3 * lists.pairs


# -- 4 token files


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, part_bytes=5000)
    assert spark.read.parquet(path).select("part").distinct().count() > 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    back = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (back[i].start, back[i].n_tokens, bytes(back[i].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_rans_decodes_from_any_checkpoint():
    rng = np.random.default_rng(1)
    tokens = np.concatenate([rng.integers(0, 500, 20_000), np.zeros(30_000, np.int64), [49_999]])
    table = token_files.Table.counted(tokens)
    table = token_files.Table.unpacked(table.packed())
    code, states, read = token_files.encode_block(tokens, table, 16)
    assert len(states) > 3 and len(code) < 2 * len(tokens)
    for first in range(len(states)):
        part = token_files.decode_block(code, states, read, len(tokens), table, table.slots(), first)
        assert (part == tokens[first * token_files.CHECKPOINT_STEPS * 16 :]).all()


def test_damaged_token_file_is_an_error(spark, docs, tmp_path):
    path, bad = str(tmp_path / "a"), str(tmp_path / "b")
    token_files.write_token_files(docs, path)
    spark.read.parquet(path).withColumn("code", F.concat(F.lit(b"\x01"), F.expr("substring(code, 2)"))).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, bad).collect()


# -- 5 Jaccard join


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("tile", [2048, 3])
def test_jaccard_components_equal_brute_force(docs, texts, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_POINTS", tile)
    monkeypatch.setattr(jaccard, "PIVOTS", 8 if tile > 3 else 1)
    monkeypatch.setattr(jaccard, "UNMARKED", 7 / 8 if tile > 3 else 1)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 400_000 if tile > 3 else 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs).collect()}
    want = brute_components(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def near_copies(n, words=60):
    """Texts that differ from one base in a word each, but for the last few, which hang on the base by a chain."""
    base = [f"w{k}" for k in range(words)]
    out = {}
    for i in range(n):
        own = list(base)
        own[i % words] = f"x{i}"
        out[i] = " ".join(own)
    for k in range(1, 5):
        own = [*(f"t{j}" for j in range(6 * k)), *base[6 * k :]]
        out[n + k] = " ".join(own)
    return out


def test_a_large_group_of_near_copies_moves_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_POINTS", 40)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 2000)
    moved = []
    edges = jaccard._edges

    def counted(rows, keys, forest):
        moved.append(rows.count())
        return edges(rows, keys, forest)

    monkeypatch.setattr(jaccard, "_edges", counted)
    texts = near_copies(600)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts)
    # every set meets a tile in each of the two passes, and pivots meet all of them; all pairs of tiles would be 15 times as many rows
    blocks = len({w for t in texts.values() for w in t.split()})
    assert len(moved) >= 4 and sum(moved) < 40 * len(texts), (moved, blocks)


def test_equal_sets_are_told_apart_by_two_fingerprints(spark, monkeypatch):
    texts = {1: "a b c d e f", 2: "a b c d e f", 3: "g h i j k l", 4: "m n o p q r"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = jaccard._describe(docs.withColumn("text_key", F.lit(0).cast("long")), np.zeros(jaccard.PLACES // 64, np.uint64))
    assert sets.select("mark").distinct().count() == sets.select("mark2").distinct().count() == 3
    described = jaccard._describe
    monkeypatch.setattr(jaccard, "_describe", lambda *a: described(*a).withColumn("mark", F.lit(7).cast("long")))
    copies = jaccard._components(jaccard._with_keys(docs)).where("known")
    assert sorted(r.doc_id for r in copies.collect()) == [1, 2]


def test_one_row_of_each_component_stays(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, a, 1), (1, a, 1), (1, a + " end", 2), (2, a, 3), (1, b, 4), (None, b, 5), (None, b, 5), (None, "own words stand here alone", 6), (None, None, 7), (None, None, 7), (5, " ", 8), (5, " ", 8)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, h long"))
    assert kept.columns == ["doc_id", "text", "h"]
    got = Counter(tuple(r) for r in kept.collect())
    # of the rows of id 1 around text a one stays
    assert sum(n for r, n in got.items() if r[1] and r[1].startswith("w0")) == 1
    assert got - Counter(r for r in got if r[1] and r[1].startswith("w0")) == Counter([(1, b, 4), (None, "own words stand here alone", 6), (None, None, 7), (None, None, 7), (5, " ", 8), (5, " ", 8)])


def test_count_vectors_survive_packing():
    few = np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64)
    one_group = np.arange(600, dtype=np.uint64) << np.uint64(20)
    for hashes in (few, one_group):
        vector = jaccard.count_vector(hashes)
        assert (jaccard.unpacked(jaccard.packed(vector), len(hashes)) == vector).all()


def test_count_tree_bound_loses_no_pair():
    rng = np.random.default_rng(5)
    bases = [np.unique(rng.integers(0, 2**63, 90).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([(base := bases[k % 3])[rng.random(len(base)) < p], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)])) for k, p in enumerate(rng.uniform(0.3, 1, 900))]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(sizes, [jaccard.count_vector(s) for s in sets])
    free = np.ones(len(sets), bool)
    for i in range(0, 900, 7):
        near = set(tree.near(i, free).tolist())
        for j in range(900):
            if j != i and jaccard.linked(np.array(len(np.intersect1d(sets[i], sets[j]))), len(sets[i]), np.array(len(sets[j]))):
                assert j in near
    # the summed minima close most nodes: these points are three clouds of many sizes
    assert tree.opened < 0.7 * tree.met


def test_connected_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


# -- 6 substring dedup


def brute_repeats(texts, window):
    words = {i: WORDS.findall(t or "") for i, t in texts.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), " ".join(kept))
    return out


def assert_repeats(out, texts, window=50):
    want = brute_repeats(texts, window)
    got = {r.doc_id: r for r in out.collect()}
    for i, (n, gone, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), i
    return sum(g for _, g, _ in want.values())


@pytest.mark.parametrize(("group_rows", "hot"), [(100_000, 5_000), (5, 5_000), (50, 2)])
def test_substring_dedup_equals_brute_force(docs, texts, group_rows, hot):
    assert assert_repeats(suffix_dedup.removals(docs, group_rows=group_rows, hot=hot), texts) > 1000


@pytest.mark.parametrize("hot", [5_000, 3])
def test_equal_hashes_remove_no_words_that_differ(docs, texts, hot):
    # every run of words gets one hash: all suffixes are in one group, and only their words tell them apart
    few = docs.where("doc_id < 60")
    out = suffix_dedup.removals(few, hot=hot, hashes=lambda words, length: np.zeros(max(0, len(words) - length + 1), np.uint64))
    assert assert_repeats(out, {i: t for i, t in texts.items() if i < 60}) > 100


def test_the_nodes_of_the_tree_decide_what_repeats(docs):
    class NoNodes(suffix_dedup.SuffixTree):
        def nodes(self):
            return np.arange(len(self.order))

    alone = docs.where("doc_id % 9 = 0").repartition(13, "doc_id")
    assert suffix_dedup.removals(alone).agg(F.sum("n_removed")).first()[0] > 300
    assert suffix_dedup.removals(alone, tree=NoNodes).agg(F.sum("n_removed")).first()[0] < 300


def test_suffix_tree_orders_leaves_and_measures_common_prefixes():
    import pyarrow as pa

    rng = random.Random(4)
    runs = [[rng.choice("ab") for _ in range(rng.randint(7, 20))] for _ in range(40)]
    tree = suffix_dedup.SuffixTree(pa.array([" ".join(r) for r in runs]), np.array([len(r) - 6 for r in runs]), 7)
    leaves = [tuple(r[k : k + 7]) for r in runs for k in range(len(r) - 6)]
    # a word sorts by when it was met first
    number = {w: k for k, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
    ordered = [leaves[k] for k in tree.order]
    assert ordered == sorted(leaves, key=lambda leaf: [number[w] for w in leaf])
    assert tree.common.tolist() == [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(ordered, ordered[1:])]
    docs = np.array([rng.randint(0, 9) for _ in leaves])
    least = {leaf: min(d for d, x in zip(docs, leaves) if x == leaf) for leaf in set(leaves)}
    assert tree.later(docs).tolist() == [d > least[leaf] for d, leaf in zip(docs, leaves)]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b + " " + a), (None, b), (None, b)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 60, 0), (0, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (3, 120, 120)]


def test_remove_repeats_leaves_clean_texts_alone(docs, texts):
    want = brute_repeats(texts, 50)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else texts[r.doc_id])


# -- 7 LM scores


def test_base_scores_are_exact_and_the_model_learns(docs, texts):
    counts = Counter()
    for i, t in texts.items():
        if fixtures.crc(i) % 10:
            counts.update(WORDS.findall(lowered(t)))
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.score(docs, chunk_bytes=4000).collect()}
    for i, t in texts.items():
        tokens = [*WORDS.findall(lowered(t)), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fixtures.crc(i) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [got[i] for i, t in texts.items() if got[i].held_out and t and len(t) > 200]
    # far better than 256 equally likely bytes
    assert all(r.score > -len(texts[r.doc_id].encode()) * 1.4 for r in held)


class BrutePpm:
    """The model by its definition: counts of symbols behind contexts, one byte at a time, in exact fractions of counts."""

    def __init__(self, texts, order):
        self.order = order
        self.seen = defaultdict(Counter)
        for t in texts:
            padded = b"\0" * order + t + b"\0"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.seen[padded[i - k : i]][padded[i]] += 1

    def log10(self, text):
        padded, total = b"\0" * self.order + text + b"\0", 0.0
        for i in range(self.order, len(padded)):
            out: set = set()
            for k in range(self.order, -1, -1):
                symbols = self.seen.get(padded[i - k : i])
                if not symbols:
                    continue
                fresh = {s: n for s, n in symbols.items() if s not in out}
                mass = sum(fresh.values())
                if padded[i] in fresh:
                    total += math.log10((fresh[padded[i]] - 0.5) / mass)
                    break
                if mass:
                    total += math.log10(len(fresh) / 2 / mass)
                out |= symbols.keys()
            else:
                total -= math.log10(max(1, 256 - len(out)))
        return total


def test_scores_equal_a_brute_force_model(docs, texts):
    model = BrutePpm([(t or "").encode() for i, t in texts.items() if fixtures.crc(i) % 10], lm_score.ORDER)
    for chunk_bytes, fan in ((3000, 64), (3000, 2), (1 << 24, 64)):
        for r in lm_score.score(docs, chunk_bytes=chunk_bytes, fan=fan).collect():
            assert math.isclose(r.score, model.log10((texts[r.doc_id] or "").encode()), rel_tol=1e-5), r.doc_id


def test_one_common_context_meets_in_small_groups(spark, monkeypatch):
    rng = random.Random(8)
    # behind each " th" any letter: all chunks ask for the windows of one context
    have = {i: " ".join("th" + rng.choice("aeiou") + rng.choice("abcdefgh") for _ in range(60)) for i in range(400)}
    docs = spark.createDataFrame(list(have.items()), "doc_id long, text string")
    levels = []

    def recorded(df, name):
        out = staged(df, name)
        if name == "lm-questions":
            levels.append(out)
        return out

    want = {r.doc_id: r for r in lm_score.score(docs, chunk_bytes=4000).collect()}
    monkeypatch.setattr(lm_score, "staged", recorded)
    n_chunks, fan = -(-sum(map(len, have.values())) // 4000), 4
    assert lm_score._widths(n_chunks, fan) == [16, 4, 1]
    got = {r.doc_id: r for r in lm_score.score(docs, chunk_bytes=4000, fan=fan).collect()}
    assert got == want and len(levels) == 2
    for level in levels:
        met = level.groupBy(F.floor(F.col("chunk") / fan), "bucket").count().toPandas()["count"]
        assert met.max() <= fan and met.sum() <= fan * n_chunks


def test_languages_equal_a_brute_force_model(docs, texts):
    langs = {r[0]: r[2] for r in fixtures.rows()}
    names = sorted({x for x in langs.values() if x})
    models = [BrutePpm([t.encode() for i, t in texts.items() if fixtures.crc(i) % 4 != 2 and t is not None and langs[i] == n], language_id.ORDER) for n in names]
    for r in language_id.identify(docs).collect():
        t = texts[r.doc_id]
        if t and language_id._LETTER.search(t):
            nats = np.array([m.log10(t.encode()) * math.log(10) for m in models])
            assert r.lang_pred == names[nats.argmax()]
            assert abs(r.score - 1 / np.exp(nats - nats.max()).sum()) < 1e-3


def test_every_string_of_a_larger_corpus_is_held(spark):
    from revscope.llm.ppm import Model, level_tables, windows

    rng = random.Random(5)
    # more than 2^20 training positions, most of their longer strings rare
    have = {i: " ".join("".join(rng.choices("abcdefghijklmnop\u00e9", k=rng.randint(2, 9))) for _ in range(1100)) for i in range(250)}
    raw = [have[i].encode() for i in have if fixtures.crc(i) % 10]
    keys, counts = np.unique(windows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)[0], return_counts=True)
    assert counts.sum() > 1 << 20 and (counts == 1).mean() > 0.5
    model = Model(5, *zip(*(level_tables(keys, counts, k) for k in range(6)), strict=True))
    docs = spark.createDataFrame(list(have.items()), "doc_id long, text string")
    for chunk_bytes in (1 << 18, 1 << 30):
        for r in lm_score.score(docs, chunk_bytes=chunk_bytes).collect():
            own = have[r.doc_id].encode()
            want = model.log10(windows(np.frombuffer(own, np.uint8), np.array([0, len(own)]), 5)[0]).sum()
            assert math.isclose(r.score, want, rel_tol=1e-6)


def test_model_probabilities_sum_to_one():
    from revscope.llm.ppm import Model, merged, windows

    raw = np.frombuffer(b"abracadabra abracadabra the cat sat on the mat" * 3, np.uint8)
    keys, counts = np.unique(windows(raw, np.array([0, len(raw)]), 3)[0], return_counts=True)
    grams, contexts = [], []
    for k in range(4):
        a, b = merged(keys & np.uint64((1 << (8 * (k + 1))) - 1), counts)
        x, y = merged(a >> np.uint64(8), b)
        grams.append((a[b >= 2], b[b >= 2].astype(float)))
        contexts.append((x[y >= 2], y[y >= 2].astype(float)))
    model = Model(3, grams, contexts)
    for context in (b"abr", b"the", b"zzz", b"\0\0\0"):
        window = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.log10(window)).sum() - 1) < 1e-9


# -- 8 media


def test_media_columns_round_trip(docs, texts):
    stored = staged(media.encode_wav(docs), "test-media")
    for r in media.digest(media.sniff(stored)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.wav(payload)), hashlib.sha256(media.wav(payload)).hexdigest())


def test_sniffing_confirms_structure(spark):
    import gzip
    import struct

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"xyz") + chunk(b"IEND", b"")
    wav, zipped = media.wav(b"\x80" * 100), gzip.compress(b"hello" * 50)
    broken = png[:20] + b"?" + png[21:]
    rows = [(0, png, "image/png", 1), (1, wav, "image/png", 1), (2, b"text " + png + b" more " + zipped + b" BM RIFF fLaC", "text", 1), (3, broken, "image/png", 1), (4, None, None, 1), (5, b"", "x", 1), (6, zipped, "application/gzip", 1)]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id int, media binary, declared string, type int")).collect()}
    assert [got[i].type for i in range(7)] == ["image/png", "audio/wav", media.UNKNOWN, media.UNKNOWN, None, media.UNKNOWN, "application/gzip"]
    assert [got[i].corrected for i in (0, 1, 3, 4)] == [False, True, True, None]
    assert [(e.type, e.offset, e.length) for e in got[2].embedded] == [("image/png", 5, len(png)), ("application/gzip", 11 + len(png), len(zipped))]
    assert media.samples_of(media.wav(b"abc")) == b"abc"


def test_validators_want_whole_structures():
    import io
    import zipfile

    one_zip = io.BytesIO()
    with zipfile.ZipFile(one_zip, "w") as z:
        z.writestr("a.txt", "hello" * 20)
        z.writestr("b.txt", "x")
    zipped = one_zip.getvalue()
    assert media._zip(b"__" + zipped + b"tail", 2) == len(zipped)
    at = zipped.index(b"PK\x01\x02")
    assert media._zip(zipped[:at] + b"PK\x01\x00" + zipped[at + 4 :], 0) == 0
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF\n2 0 obj\nendobj\nstartxref\n9\n%%EOF"
    assert media._pdf(pdf + b"\nrest %PDF-1.7", 0) == len(pdf)
    assert media._pdf(b"%PDF-1.4 1 0 obj some words %%EOF", 0) == 0
    head = b"\xff\xf8\x69\x18\x00\x0f"  # one block of 16 samples
    frame = head + bytes([media._crc(head, 7, 8)]) + b"\0" * 4
    frame += media._crc(frame, 0x8005, 16).to_bytes(2, "big")
    flac = b"fLaC" + b"\x80\0\0\x22" + b"\0" * 34 + frame + frame
    assert media._flac(flac, 0) == len(flac)
    assert media._flac(b"fLaC" + b"\x80\0\0\x22" + b"\0" * 34 + b"no frame here", 0) == 0
    assert media._flac(flac[:-1] + b"\x00", 0) in (0, len(flac) - len(frame))


# -- 9 language ID


def test_language_id_on_held_out_texts(docs, texts):
    langs = {r[0]: r[2] for r in fixtures.rows()}
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        lettered = bool(t and language_id._LETTER.search(t))
        assert (got[i].lang_pred == "und") == (not lettered) and 0 <= got[i].score <= 1
        assert got[i].held_out == (fixtures.crc(i) % 4 == 2)
    held = [i for i, t in texts.items() if got[i].held_out and t and len(t) > 60 and langs[i]]
    assert len(held) > 10 and sum(got[i].lang_pred == langs[i] for i in held) >= 0.9 * len(held)


def test_language_stage_keeps_lettered_documents(docs, texts):
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts.items() if t and language_id._LETTER.search(t)}


def test_language_stage_judges_each_row_by_itself(spark):
    rows = [(None, "a clean text without an id", "en"), (None, "another one", "en"), (None, "123", "en"), (7, "words of a text", "en"), (7, "4 5 6", "en"), (8, "und noch ein Text", "de"), (8, None, "de")]
    kept = language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[1] and language_id._LETTER.search(r[1]))


# -- 10 packing


@pytest.mark.parametrize("group_rows", [20_000, 12])
def test_packing_is_whole_and_tight(docs, texts, group_rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    got = packing.pack(packing.pieces(docs), group_rows=group_rows).toPandas()
    total = sum(map(len, ids.values()))
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert own["length"].sum() == len(ids[i]) and (own["length"].iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
    assert len(set(got["doc_id"])) == len(ids) and got["sequence_id"].nunique() <= -(-total // 2048) + 1


def test_local_search_empties_bins():
    sizes = np.array([60, 50, 50, 40, 30, 30, 20, 20])
    bins = packing.local_search([[0, 4], [1, 3], [2, 5], [6], [7]], sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(8)) and all(sizes[b].sum() <= 100 for b in bins) and len(bins) == 3


def test_local_search_ends_when_no_exchange_is_left():
    rng = np.random.default_rng(3)
    sizes = rng.integers(600, 1100, 600)
    start = packing.best_fit(sizes, 2048)
    assert sum(sizes[b].sum() < 2048 for b in start) > 200
    bins = packing.local_search(start, sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(600)) and len(bins) < len(start)
    fill = [int(sizes[b].sum()) for b in bins]
    assert max(fill) <= 2048
    for d, mine in enumerate(bins):
        own = sizes[mine]
        sums = np.array([*own, *(own[x] + own[y] for x in range(len(own)) for y in range(x))])
        for o, theirs in enumerate(bins):
            if o != d:
                gain = sums[:, None] - np.array([0, *sizes[theirs]])[None, :]
                assert not ((gain > max(0, fill[d] - fill[o])) & (gain <= 2048 - fill[o])).any()


def test_best_fit_and_search_come_within_one_bin_of_the_optimum():
    def optimum(sizes, length):
        # fewest bins over all subsets: (bins, fill of the last one), filled in every order
        best = {0: (0, length)}
        for chosen in range(1, 1 << len(sizes)):
            best[chosen] = min((b, f + s) if f + s <= length else (b + 1, s) for i, s in enumerate(sizes) if chosen >> i & 1 for b, f in [best[chosen ^ (1 << i)]])
        return best[(1 << len(sizes)) - 1][0]

    rng, met = np.random.default_rng(9), 0
    for _ in range(150):
        sizes = rng.integers(10, 70, rng.integers(1, 10))
        bins = packing.local_search(packing.best_fit(sizes, 100), sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 100 for b in bins)
        least = optimum(sizes.tolist(), 100)
        assert len(bins) <= least + 1
        met += len(bins) == least
    assert met >= 140


def test_groupings_end_where_they_free_hardly_any_bin(spark, monkeypatch):
    rng = random.Random(10)
    sizes = [rng.randint(300, 799) for _ in range(1500)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECES)
    rounds = []
    monkeypatch.setattr(packing, "_pack_groups", lambda *args, of=packing._pack_groups: rounds.append(args[3]) or of(*args))
    free = packing.pack(rows, group_rows=100).toPandas()
    assert free["sequence_id"].nunique() <= -(-sum(sizes) // 2048) * 1.05
    monkeypatch.setattr(packing, "LEAST_FREED", 1.0)
    rounds.clear()
    ended = packing.pack(rows, group_rows=100).toPandas()
    # each series ends after its stalls; what they freed is kept
    assert len(rounds) <= 1 + 2 * packing.STALLS
    for out in (free, ended):
        assert sorted(out["doc_id"]) == list(range(1500)) and out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_sequences_hold_the_tokens(docs):
    out = packing.sequences(docs).toPandas()
    assert all(len(r.ids) == 4 * r.n_tokens for r in out.itertuples()) and out["n_tokens"].max() <= 2048


def test_packed_pieces_keep_their_ids_where_doc_ids_repeat(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (3, "d e f"), (3, "d e f"), (3, "g " * 3000)]
    placed = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True)).collect()
    assert len(placed) == 5 + 2 and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in placed)
    places = [(r.sequence_id, r.offset + k) for r in placed for k in range(r.length)]
    assert len(set(places)) == len(places)


# -- all


def test_empty_tables(spark):
    none = fixtures.empty(spark)
    assert sharding.shard_plan(none).count() == 0
    assert bpe.digests(none).count() == 0
    assert jaccard.components_of(none).count() == 0
    assert suffix_dedup.removals(none).count() == 0
    assert lm_score.score(none).count() == 0
    assert media.digest(media.sniff(media.encode_wav(none))).count() == 0
    assert language_id.identify(none).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0


def test_empty_token_files(spark, tmp_path):
    token_files.write_token_files(fixtures.empty(spark), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g h"), (None, None), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "other words in this one here"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (sharding.shard_plan(df, 2), bpe.digests(df), jaccard.components_of(df), suffix_dedup.removals(df, 3, run=2), lm_score.score(df), media.digest(media.sniff(media.encode_wav(df))), packing.pack(packing.pieces(df)), language_id.identify(df.withColumn("lang", F.lit("en")))):
        assert out.count() == len(rows)
    assert keyed(df).count() == 6
