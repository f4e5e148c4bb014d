"""The near-duplicate stage's fingerprints: what they are, that they link, and that they keep a group's pairs few."""

import random

import numpy as np
import pytest
from test_jaccard import brute, edited
from test_pipeline import SF

import corpus_pipeline
from barweave.llm import jaccard, simhash


@pytest.fixture
def verified(monkeypatch):
    """The pairs that each round verifies, and whether they are near."""
    rounds, whole = [], jaccard._verified

    def spy(named, shingle, pairs):
        found = whole(named, shingle, pairs)
        rounds.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in found.collect()}))
        return found

    monkeypatch.setattr(jaccard, "_verified", spy)
    return rounds


def test_by_brute_force(spark):
    rng = np.random.default_rng(3)
    n = np.array([0, 1, 2, 254, 255, 256, 0, 511, 1000, 0])
    h = rng.integers(0, 1 << 64, n.sum(), dtype=np.uint64, endpoint=False)
    kind = jaccard.arrow_schema("print array<long>").field(0).type
    row = np.repeat(np.arange(len(n)), n)
    prints = jaccard._prints(h, row, n, kind).to_pylist()
    assert simhash.majority(h[:0], n[:1]).tolist() == [0]
    for i, got in enumerate(prints):
        own = [int(x) for x in h[row == i]]
        assert got[0] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
        for j in range(i):
            differ = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(got[1:], prints[j][1:]))
            assert differ <= n[i] + n[j] and (differ - n[i] - n[j]) % 2 == 0
    same = jaccard._prints(np.append(h[row == 8][:-3], h[:3]), np.zeros(1000, np.int64), n[8:9], kind).to_pylist()[0]
    assert 0 < sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(same[1:], prints[8][1:])) <= 6


def test_near_fingerprints_are_candidates(spark, monkeypatch, verified):
    """Without any meeting at shingles, fingerprints alone link copies of similarity 0.9 and more."""
    monkeypatch.setattr(jaccard, "_able", lambda *x: jaccard.F.lit(False))
    rnd = random.Random(2)
    texts = [[f"w{rnd.randrange(3000)}" for _ in range(300)] for _ in range(30)]
    texts += [edited(t, 1, rnd) for t in texts] + [["few", "words"], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got >= {*range(30), 60, 61} and len(got) <= 34
    assert len(verified[0][1]) >= 28 and not any(pairs for pairs, _ in verified[1:])


def test_group_of_copies_that_are_not_near_each_other(spark, verified):
    rnd = random.Random(5)
    base = [f"g{k}" for k in range(130)]
    texts = [edited(base, 2, rnd) for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == brute(rows)[0]
    tried = sum(len(pairs) for pairs, _ in verified)
    assert tried <= 20 * len(texts)  # of 44,850 pairs
