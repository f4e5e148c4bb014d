"""The corpus pipeline: each deterministic stage against brute force on its own input, and the whole; near-duplicates are in test_jaccard.py."""

import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from barweave.llm.common import read_table, stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_rows(spark, stages):
    for a, b in zip(stages[:4], stages[1:5]):
        assert b.columns == a.columns and 0 < b.count() <= a.count()
    total = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, total.collect())) == Counter(map(tuple, stages[5].collect()))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_clean_documents_stay(spark, stages):
    labels = read_table(spark, SF, "labels")
    good = labels.filter("quality = 1").select("doc_id")
    lettered = stages[0].filter("text rlike '[a-zA-Z]{4}'").join(good, "doc_id").count()
    kept = stages[2].join(good, "doc_id").count()
    assert kept >= 0.95 * lettered
    bad = labels.filter("quality = 0").select("doc_id")
    assert stages[2].join(bad, "doc_id").count() <= 0.2 * stages[0].join(bad, "doc_id").count()


def test_repeats_by_brute_force(stages):
    raws = {r["doc_id"]: (r["text"] or "").encode() for r in stages[3].collect()}
    seen = Counter(hash(t[k : k + 200]) for t in raws.values() for k in range(len(t) - 199))
    for r in stages[4].collect():
        t = raws[r["doc_id"]]
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        starts = [k for k in range(len(t) + 1) if k == len(t) or t[k] & 0xC0 != 0x80]
        kept = b"".join(t[a:b] for a, b in zip(starts, starts[1:]) if not any(gone[a:b]))
        assert (r["text"] or "").encode() == kept and r["n_chars"] == len(kept.decode())


def test_odd_tables(spark, docs, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs, docs.select(*columns), none):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality":
                continue  # needs labels of these documents; see test_learned
            out = stage(spark, table, SF).collect()
            assert (len(out) > 0) == (n > 0)
            if name == "suffix":
                assert len(out) == n
