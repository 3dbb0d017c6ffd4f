"""The Best Position Algorithm against whole scoring, and its edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import best_position as bp

DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=20):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts]
    n, total = sum(x > 0 for *_, x in counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in counts:
            m = 75 + 25 * size * n // max(1, total)
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, r in Counter(words(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "漢字", "ÅB"]
    odds = [1 / (i + 1) for i in range(len(vocab))]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, odds, k=rng.choice([0, 3, 10, 40, 200])))) for i in range(n)], rng, vocab


def test_terms():
    text = "Ab-c_D'é9 \x7fÀ x Y\x85"
    assert [t.decode() for t in bp.terms(text)] == words(text)
    assert bp.terms(None) == bp.terms(" .-") == []


@pytest.mark.parametrize("postings", [2_000_000, 300])
def test_against_whole_scoring(spark, monkeypatch, postings):
    monkeypatch.setattr(bp, "SHARD_POSTINGS", postings)
    docs, rng, vocab = corpus(1, 700)
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # ties at the kth place
    items = [(j, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 8, 30])))) for j in range(12)] + [(50, "nowhere"), (51, None), (52, "w1 W1 w1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS).repartition(3)
    got = bp.best_documents(df, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    docs, rng, vocab = corpus(2, 200)
    items = [(j, " ".join(rng.choices(vocab, k=4))) for j in range(9)]
    monkeypatch.setattr(bp, "BLOCK_QUERIES", 4)
    got = bp.best_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 5)


def test_other_terms_that_share_a_bit(spark, monkeypatch):
    monkeypatch.setattr(bp, "_bit", lambda term: 0)
    docs, rng, vocab = corpus(4, 100)
    items = [(0, "w1 w2"), (1, "w3")]
    got = bp.best_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_stops_early_and_never_below_the_kth():
    """One document leads all lists: the search ends after the first reads; a tie of the kth keeps it reading."""
    rng = np.random.default_rng(0)
    n, m = 5000, 3
    impact = rng.integers(1, 1000, (n, m))
    impact[:20] += 100_000
    starts, term = np.arange(n + 1) * m, np.tile(np.arange(m), n)
    shard = bp.Shard(starts, term, impact.ravel(), m)
    places, scores = shard.search([(t, 1) for t in range(m)], 20, np.arange(n))
    assert sorted(places.tolist()) == list(range(20)) and shard.accesses < 200
    flat = bp.Shard(starts, term, np.ones(n * m, np.int64), m)
    places, scores = flat.search([(t, 1) for t in range(m)], 20, np.arange(n)[::-1])
    assert places.tolist() == list(range(n - 1, n - 21, -1)) and flat.accesses == n


def test_best_positions_beat_last_read_ones():
    """Documents that lie on top of one list are looked up in the others, whose seen runs then reach past what was read."""
    n = 3000
    down = np.arange(n, 0, -1)
    impact = np.stack([down, down], axis=1)
    shard = bp.Shard(np.arange(n + 1) * 2, np.tile([0, 1], n), impact.ravel(), 2)
    shard.search([(0, 1), (1, 1)], 20, np.arange(n))
    assert shard.read <= 2 * bp.FIRST_READ


def test_edges(spark):
    docs = spark.createDataFrame([(None, "cat", "x"), (1, "cat", "x"), (1, "cat", "x"), (2, None, "x"), (3, "", "x"), (4, "dog " * 50_000, "x")], DOCS)
    items = spark.createDataFrame([(7, "cat", "x"), (7, "cat", "x"), (None, "dog", "x"), (8, " ", "x")], ITEMS)
    got = bp.best_documents(docs, items).collect()
    assert sorted((r.item_id or 0, r["rank"], r.doc_id or 0) for r in got) == [(0, 1, 4)] + sorted([(7, 1, 1), (7, 2, 1), (7, 3, 0)] * 2)
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert bp.best_documents(none, items).count() == bp.best_documents(docs, asked).count() == bp.best_documents(none, asked).count() == 0
