"""Runs that tasks combine before the shuffle: what a task happens to hold together doesn't show in the result."""

import numpy as np
import pytest

from barweave.llm import repeats, rlz, suffix


def test_classes_are_represented_by_their_least_place():
    a, c = np.array([5, 3, 5, 5], np.uint64), np.array([1, 1, 1, 2], np.uint64)
    doc, lo = np.array([9, 1, 2, 0]), np.array([0, 7, 4, 1])
    least, many, of = repeats.classed(a, c, doc, lo)
    assert (least.tolist(), many.tolist(), of.tolist()) == ([1, 2, 3], [1, 2, 1], [1, 0, 1, 2])


@pytest.mark.parametrize("operator", [suffix, rlz])
def test_results_do_not_depend_on_what_is_combined(spark, monkeypatch, operator):
    common = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{i} alone " * (i % 3) + common + f" end {i // 2}" for i in range(12)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[2]), (40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    result = lambda: sorted(map(repr, operator.deduplicate(docs).collect()))
    together = result()
    monkeypatch.setattr(repeats, "COMBINE", 1)
    monkeypatch.setattr(repeats, "CHUNK", 1)
    assert result() == together
