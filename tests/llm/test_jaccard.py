"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random
import re

import pytest
from test_pipeline import SF, WORD, stages  # noqa: F401

import corpus_pipeline


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = sorted((i, shingles(t)) for i, t in rows)
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if 5 * len(s & t) >= 4 * len(s | t):
                near += s != t
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [i for i in up if root(i) == i], near


def edited(words, changes, rnd):
    words = list(words)
    for k in rnd.sample(range(len(words)), changes):
        words[k] = f"new{rnd.random()}"
    return words


@pytest.fixture(scope="module")
def rows():
    """Originals with copies at similarities about 0.8, chains of copies, one large group, and short, odd and empty texts."""
    rnd, out = random.Random(8), []
    shared = [f"line{k}" for k in range(40)]
    for n in (30, 60, 120, 300):
        for _ in range(6):
            words = [f"w{rnd.randrange(4000)}" for _ in range(n)] + shared * rnd.randrange(2)
            out.append(words)
            for part in (0.01, 0.02, 0.022, 0.025, 0.03, 0.05):
                out.append(edited(words, max(1, round(part * n)), rnd))
            for _ in range(5):
                words = edited(words, max(1, n // 50), rnd)
                out.append(words)
    large = [f"g{k}" for k in range(200)]
    out += [edited(large, rnd.randrange(1, 7), rnd) for _ in range(60)]
    out += [large[:k] for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14)] + [["ab", "cd"] * 50, ["AB", "cd"] * 70, ["x"] * 9, ["x"] * 30]
    texts = [" ".join(w) for w in out] + [None, "", " \t\n"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_similarity_of_edited_copies(spark, rows):
    want, near = brute(rows)
    assert near > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_stage_of_the_pipeline(stages):  # noqa: F811
    want, _ = brute((r["doc_id"], r["text"]) for r in stages[2].collect())
    assert sorted(r["doc_id"] for r in stages[3].collect()) == want
