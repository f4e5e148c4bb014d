"""What a Python worker takes at a time, and keeps behind a task."""

import tracemalloc

import numpy as np
import pytest

from barweave.llm import common, langid, quality

TEXT = b"Some words, 12 of them, in a line that Goes on and on until it ends. " * 15
LIMIT = 48 << 20


def peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def view():
    rows = (4 << 20) // len(TEXT)
    return np.frombuffer(TEXT * rows, np.uint8), np.arange(rows + 1) * len(TEXT)


def test_language_takes_bounded_memory(view):
    data, offsets = view
    model = langid.LanguageFilters.build({"en": langid.grams_of(data[: len(TEXT)], offsets[:2])[0]}, {})

    def run():
        for a, b in common.row_chunks(offsets, langid.CHUNK):
            model.decide(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    assert peak(run) < LIMIT


def test_quality_takes_bounded_memory_and_scores_do_not_depend_on_chunks(view, monkeypatch):
    data, offsets = view
    words = quality.Vocabulary.build(np.unique(quality.tokens_of(data[: len(TEXT)], offsets[:2])[0]))
    rng = np.random.default_rng(1)
    layers = (np.zeros(64), np.ones(64), rng.normal(size=(64, 32)), np.zeros(32), rng.normal(size=32), np.zeros(()))
    model = quality.QualityModel(words, rng.normal(size=(words.size, 64)).astype(np.float32), layers, 1.0)
    scores = []
    assert peak(lambda: scores.append(model.score(data, offsets))) < LIMIT
    monkeypatch.setattr(quality, "CHUNK", 1 << 21)
    np.testing.assert_allclose(model.score(data, offsets), scores[0], rtol=1e-12)


def test_lean_gives_back_behind_the_last_batch(monkeypatch):
    order = []
    monkeypatch.setattr(common, "give_back", lambda: order.append("back"))
    for x in common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        order.append(x)
    assert order == [2, 3, "back"]
