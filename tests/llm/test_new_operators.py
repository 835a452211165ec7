"""Shards, hard negatives and source divergence: against plain versions, on odd rows, and at their borders."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm.divergence import RadixTrie, divergence, share, terms_of
from glossa.llm.hard_negatives import Turned, best, hard_negatives
from glossa.llm.sharding import sharded

ROWS = [(1, "a b"), (2, "a b"), (2, "a b"), (2, "other"), (None, None), (None, ""), (3, "é" * 50_000)]


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("shard", "slot", "law", "__part", "__at", "__by", "__n", "key")}).repartition(3)
    got = sharded(docs, dict.fromkeys(range(4), 1), dict.fromkeys(range(5), 1)).collect()
    assert len(got) == len(ROWS) and all(r.law == "key" and r.key == r["__part"] == r["__at"] == r["__by"] == r["__n"] == "mine" for r in got)
    assert len({r.shard for r in got if r.doc_id == 2}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 3] == [(100_001, zlib.crc32(("é" * 50_000).encode()))]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharded(docs.where("false"), {0: 1}).count() == 0


def test_one_row_repeated_many_times_has_gapless_slots(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text")).repartition(5)
    got = sharded(docs, {0: 1, 1: 1}).select("shard", "slot", "doc_id").collect()
    for s in (0, 1):
        mine = sorted((r.slot, r.doc_id) for r in got if r.shard == s and r.doc_id is not None)
        assert [x[1] for x in mine] == sorted(x[1] for x in mine)
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_weights_hold_and_few_records_move(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weights = {0: 1, 1: 2, 2: 5, 3: 0}
    got = sharded(docs, weights, weights | {4: 2}).select("shard", "grown_shard").collect()
    n = Counter(r.shard for r in got)
    assert all(abs(n[s] / 20_000 - w / 8) < 0.015 for s, w in weights.items()) and n[3] == 0
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.015
    with pytest.raises(ValueError, match="weight"):
        sharded(docs, {0: 0})


def plain_negatives(rows, positives=5, negatives=10):
    fine = [(k, i, (la + 1) % 10 if i is not None and i % 7 == 0 else la, [math.floor(256 * float(x)) for x in v]) for k, (i, v, la) in enumerate(rows) if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, la, v in fine:
        if i is None or i % 100:
            continue
        near = sorted(((dot(v, w), j) for m, j, lb, w in fine if m != k and lb == la), key=order)[:positives]
        for ps, pid in near:
            far = sorted(((s, j) for s, j in ((dot(v, w), j) for _, j, lb, w in fine if lb != la) if 30 * ps <= 100 * s <= 90 * ps), key=order)[:negatives]
            out += [(i, pid, n, j, ps, s) for n, (s, j) in enumerate(far, 1)]
    return sorted(out, key=repr)


NEG = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_those_of_all_products(spark, seed):
    """Clustered and flat vectors, equal rows, repeated and null ids, nulls, other lengths, and non-finite components."""
    random.seed(seed)
    rows = []
    for i in range(900):
        centre = [random.Random(i % 6).uniform(-1, 1) * (6 if seed == 1 else 0.1) for _ in range(40)]
        rows.append((i, [c + random.uniform(-1, 1) for c in centre], random.randrange(10)))
    rows += [(100, rows[5][1], 3), (100, rows[5][1], 3), (None, rows[200][1], 4), (901, None, 1), (902, [1.0, None], 1), (903, [float("nan")] * 40, 2), (904, [float("inf")], 2), (905, rows[7][1], None), (906, [], 2), (1000, [0.0] * 40, 5), (1100, [2.0, -3.0], 5)]
    rows += [(2000 + i, [1.0] * 40, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("rk", "first", "rank", "score", "low")}).repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted((tuple(r[c] for c in NEG) for r in hard_negatives(df, block_rows=200).collect()), key=repr)
    assert got == plain_negatives(rows) and len(got) > 100


def test_no_vectors_give_no_negatives(spark):
    df = spark.createDataFrame([(0, None, 1), (100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df).count() == 0 and hard_negatives(df.where("false")).count() == 0


def test_bounds_leave_most_products_out():
    """Where leading components hold nearly all, most rows are left out, and the best are those of all products."""
    draw = np.random.default_rng(5)
    ints = np.floor(draw.normal(size=(2000, 64)) * (600 / (1 + np.arange(64) ** 1.5))).astype(np.int64)
    turn = np.linalg.eigh((ints.T @ ints).astype(float))[1][:, ::-1].copy()
    a, v = Turned(ints[:20], turn, (8, 16)), Turned(ints, turn, (8, 16))
    from glossa.llm import hard_negatives as H

    sizes, plain = [], H.exact
    try:
        H.exact = lambda x, y: sizes.append(len(x)) or plain(x, y)
        [(i, j, s)] = best(a, v, np.ones((20, 2000), bool), [(np.full(20, -(2**62)), np.full(20, 2**62))], 5, np.arange(2000), np.zeros(2000, bool), (8, 16))
    finally:
        H.exact = plain
    full = ints[:20] @ ints.T
    assert [set(s[i == k]) for k in range(20)] == [set(np.sort(full[k])[-5:]) for k in range(20)] and sum(sizes) < 2000


def plain_divergence(rows, most=200, least=3):
    text = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs, by = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, t in rows:
        words = text(t)
        by[lang or ""][source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in by.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s, counts in [*sources.items(), (None, sum(sources.values(), Counter()))]:
            n = sum(counts[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], p[None][t]), t) for t in kept if sources[s][t] and p[s][t] > p[None][t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, n, r) for r, (n, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, n, r) for r, (n, t) in enumerate(terms[:most], 1)]
    return sorted(out)


def test_divergence_equals_plain_counting(spark):
    random.seed(3)
    words = ["a", "B", "ab", "abc", "é", "éa", "漢字", "漢", "😀x", "x" * 3000, "x" * 2999 + "y", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    rows = [(random.choice(["en", "fr", None]), random.choice(["s1", "s2", "s3", None, "é"]), " 1,".join(random.choices(words, k=random.randint(0, 60)))) for _ in range(150)]
    rows += [("de", "one", "a a a"), ("de", "one", "a b"), ("xx", "p", "few words"), ("xx", "q", None), ("xx", "r", "few"), ("en", "bare", ""), ("en", "bare", "123 4"), ("en", "long", "alpha " * 300_000 + "omega")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("x") for c in ("term", "item", "value", "rank", "block", "piece", "n", "part")}).repartition(4)
    for limits in ({}, {"most_terms": 3, "block_counts": 24}):
        got = sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in divergence(df, **limits).collect())
        assert got == plain_divergence(rows, limits.get("most_terms", 200))
    assert divergence(df.where("false")).count() == 0


def test_a_trie_walks_in_the_order_of_bytes():
    random.seed(9)
    terms = {bytes(random.choices(b"ab\xc3\xa9", k=random.randint(1, 9))) for _ in range(4000)} | {b"a" * 500, b"a" * 500 + b"b", b"a" * 499 + b"c"}
    trie = RadixTrie(most=8)
    for t in sorted(terms, key=lambda _: random.random()):
        trie.leaf(t)[0] += 1
    for t in terms:
        trie.leaf(t)[0] += 1
    assert [(t, x[0]) for t, x in trie.leaves()] == [(t, 2) for t in sorted(terms)]


def test_terms_are_not_cut_between_pieces():
    text = ("Été 漢字 x1Y-" * 50).encode()
    assert [w for part in terms_of(text, 7) for w in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_shares_are_whole_numbers_beyond_64_bits():
    counts = np.array([0, 5, 9_000_000_000, 3 * 10**12], np.int64)
    assert share(counts, 4 * 10**12, 1000).tolist() == [1 + 10**9 * (int(c) + 1) // (4 * 10**12 + 1000) for c in counts]
