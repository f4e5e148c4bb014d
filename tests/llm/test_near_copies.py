"""Recall of the vector index on a table of which a third are near or exact copies, in lists far over the rerank size."""

import numpy as np
import pandas as pd
import pytest

from barweave.llm import ann


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20000, 64))
    copies = rng.choice(20000, 6600, replace=False)
    x[copies] = x[copies[0]] + 0.01 * rng.normal(size=(6600, 64))
    x[copies[:800]] = x[copies[0]]  # exact copies
    return rng.permutation(20000).astype(np.int64), x, copies


def recall(spark, table, **kw):
    ids, x, copies = table
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(4)
    index = ann.build(df, **kw)
    asked = np.concatenate([copies[:1], copies[790:840], np.setdiff1d(np.arange(20000), copies)[:50]])
    queries = index.table.filter(index.table["id"].isin(ids[asked].tolist())).select("id", "v")
    got = ann.search(index, queries, 5, probes=len(index.sizes) if kw else None).toPandas()
    found, size = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}, np.sqrt((x * x).sum(1))
    shares = []
    for i in asked.tolist():
        score = (x * x[i]).sum(1) / (size * size[i])
        order = np.lexsort((ids, -score))
        shares.append(len(found[ids[i]] & set(ids[order[order != i][:5]])) / 5)
    return index, np.mean(shares[:51]), np.mean(shares[51:])


def test_every_list_visited_is_exact(spark, table):
    index, near, other = recall(spark, table, lists=8)
    assert index.sizes.max() > 1000
    assert (near, other) == (1, 1)


def test_recall_of_near_copies_by_default(spark, table):
    _, near, other = recall(spark, table)
    print("recall of copies and of others:", near, other)
    assert near >= 0.9 and other >= 0.9
