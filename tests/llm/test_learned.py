"""Language filters, the quality classifier and nearest neighbours: exactness of the parts, accuracy and recall of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import ann, langid, quality
from barweave.llm.common import fold, read_table, utf8_view

SF = "/root/testdata/sf0.01"


# -- language ----------------------------------------------------------------------------------------


def test_filters_return_all_languages():
    rng = np.random.default_rng(1)
    grams = {f"l{i:02d}": rng.choice(1 << 31, 500, replace=False).astype(np.uint32) for i in range(70)}
    grams["l69"][:100] = grams["l00"][:100]
    model = langid.LanguageFilters.build(grams, {}, rows_log2=14)
    assert model.table.shape == (1 << 14, 2)
    for i, lang in enumerate(model.langs):
        masks = model.masks(grams[lang])
        assert (((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) == 1).all()  # no false negatives
    other = rng.choice(1 << 31, 20000).astype(np.uint32) | np.uint32(1 << 31)
    hits = (model.masks(other)[:, 0] & np.uint64(1)).mean()
    assert abs(hits - model.false_rate[0]) < 0.01


def test_grams_stay_inside_texts():
    import pyarrow as pa

    data, offsets = utf8_view(pa.array(["Ab", None, "", "c-d"]))
    grams, owner = langid.grams_of(data, offsets)
    show = [(bytes([g >> 24 & 255, g >> 16 & 255, g >> 8 & 255, g & 255]), int(o)) for g, o in zip(grams.tolist(), owner)]
    assert show == []
    data, offsets = utf8_view(pa.array(["Abcd!", "xyz"]))
    grams, owner = langid.grams_of(data, offsets)
    show = [(bytes([g >> 24 & 255, g >> 16 & 255, g >> 8 & 255, g & 255]), int(o)) for g, o in zip(grams.tolist(), owner)]
    assert show == [(b" abc", 0), (b"abcd", 0), (b"bcd ", 0), (b" xyz", 1), (b"xyz ", 1)]


def test_language_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    got = langid.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_cases(docs, none, texts):
    got = langid.document_languages(docs).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i in (30, 31, 32, 42):
        assert (by[i]["lang_pred"], by[i]["score"]) == (langid.UNKNOWN, 0.0)
    assert {r["lang_pred"] for r in got} == {"en", "und"}
    assert by[None]["held_out"] is False
    assert langid.document_languages(none).collect() == []
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.document_languages(blind).collect()} == {"und"}


# -- quality -----------------------------------------------------------------------------------------


def test_quality_accuracy(spark):
    docs, labels = read_table(spark, SF.replace("0.01", "0.1"), "documents"), read_table(spark, SF.replace("0.01", "0.1"), "labels")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.document_quality(some, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    bad, good = held[held["quality"] == 0]["score"], held[held["quality"] == 1]["score"]
    assert (bad.to_numpy()[:, None] < good.to_numpy()[None, :]).mean() > 0.97
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_quality_cases(spark, docs, none, texts):
    schema = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "clash") for i in range(12)] + [(3, 1, "clash"), (20, None, ""), (None, 1, "")], schema)
    got = quality.document_quality(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (30, 31, 32)}
    assert len(empty) == 1
    assert quality.document_quality(none, labels).collect() == []
    one = spark.createDataFrame([(i, 1, "") for i in range(12)], schema)
    assert {r["score"] for r in quality.document_quality(docs, one).collect()} == {1.0}
    assert {r["score"] for r in quality.document_quality(docs, one.limit(0)).collect()} == {0.5}


def test_temperature_and_pooling():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 3, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-z / 2.5))).astype(float)
    assert abs(quality.temperature(z, y) - 2.5) < 0.2
    words = quality.Vocabulary.build(np.zeros(0, np.uint64))
    model = quality.QualityModel(words, rng.normal(size=(words.size, 8)).astype(np.float32), (), 1.0)
    data = np.frombuffer(b"ab cd ab 12 !! ", np.uint8)
    ids, rows = words.ids(data, np.array([0, len(data)]))
    assert ids.tolist()[-1] == quality.REPEAT and len(ids) == 6 and set(rows) == {0}
    np.testing.assert_allclose(model.pooled(data, np.array([0, 0, len(data)])), [np.zeros(8), model.vectors[ids].mean(0)], rtol=1e-5)
    long = np.frombuffer(b"word, other; " * 100000, np.uint8)
    ids, _ = words.ids(long, np.array([0, len(long)]))
    np.testing.assert_allclose(model.pooled(long, np.array([0, len(long)]))[0], model.vectors[ids].astype(float).mean(0), rtol=1e-4, atol=1e-5)


# -- nearest neighbours ---------------------------------------------------------------------------------


def brute(ids, x, every, k):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        s = u @ u[a]
        order = [b for b in np.lexsort((ids, -s)) if ids[b] != ids[a]][:k]
        out[ids[a]] = [(int(ids[b]), float(s[b])) for b in order]
    return out


def test_recall(spark):
    p = read_table(spark, SF.replace("0.01", "0.1"), "embeddings")
    got = ann.neighbours(p).toPandas()
    pdf = p.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float), 50, 5)
    pairs = set(zip(got["query_id"], got["vec_id"]))
    true = {(q, i) for q, near in want.items() for i, _ in near}
    assert len(pairs & true) / len(true) >= 0.9
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    for q, i, s in zip(got["query_id"], got["vec_id"], got["score"]):
        assert abs(exact.get((q, i), s) - s) < 1e-12
    assert (got.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()


def test_vector_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)], "clash", 1) for i in range(1, 30)]
    rows += [(50, rows[4][1], "", 0), (60, rows[4][1], "", 0), (61, None, "", 0), (62, [0.0] * 6, "", 0), (63, [float("nan")] + [1.0] * 5, "", 0), (64, [1.0] * 5 + [float("inf")], "", 0), (65, [None] + [1.0] * 5, "", 0), (66, [1.0, 2.0], "", 0), (None, [1.0] * 6, "", 0), (100, [1e300] * 6, "", 0), (150, [1e-300] * 6, "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, v int")
    got = ann.neighbours(df).toPandas()
    fine = [(i, np.array(v) / np.abs(v).max()) for i, v, _, _ in rows if i is not None and i not in range(61, 67)]
    want = brute(np.array([i for i, _ in fine]), np.stack([v for _, v in fine]), 50, 5)
    for q, near in want.items():
        own = got[got["query_id"] == q].sort_values("rank")
        np.testing.assert_allclose(own["score"], [s for _, s in near], atol=1e-9)
    assert got[got["query_id"] == 50]["vec_id"].tolist()[:2] == [5, 60]  # equal scores: the smaller id
    few = ann.neighbours(df.filter("vec_id IN (50, 60, 1)"))
    assert [(r["query_id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(50, 1), (50, 2)]
    assert ann.neighbours(df.limit(0)).collect() == []
    assert ann.neighbours(df.filter("vec_id = 50")).collect() == []


def test_slices_do_not_change_results(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(400)]
    index = ann.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lists=3)
    queries = index.table.filter("id % 50 = 0").select("id", "v")
    whole = sorted(map(tuple, ann.search(index, queries, probes=3).collect()))
    cut = sorted(map(tuple, ann.search(index, queries, probes=3, slice_rows=5).collect()))
    assert whole == cut and len(whole) == 40


@pytest.mark.parametrize("mod", [3, 4, 5])
def test_fold(spark, mod):
    import zlib

    df = spark.range(300).withColumn("f", fold(F.col("id"), mod))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % mod for r in df.collect())


def test_repeated_ids_and_lengths(spark):
    """Rows of one id are one vector; vectors meet those of their own length; many lists of two levels lose nothing when all are visited."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(0, 300, 7)] + [(50, (x[50] + 1).tolist()), (3, (x[3] - 1).tolist())]
    short = rng.normal(size=(40, 4))
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(short)] + [(2000, [1.0]), (None, x[0].tolist())]
    one: dict = {}
    for i, v in rows:
        one[i] = min(one.get(i, v), v)
    one.pop(None)
    want = []
    for i, v in one.items():
        others = [(-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), j) for j, w in one.items() if j != i and len(w) == len(v)]
        want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(sorted(others)[:5])] if i % 50 == 0 else []
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.neighbours(table).collect()]
    found = {r[:3] for r in got} & {r[:3] for r in want}
    assert len(got) == len(set(got)) == len(want) and len(found) >= 0.95 * len(want)
    index = ann.build(table, lists=3, list_rows=10)
    assert len(index.quantiser.inner) > 5 and len(index.sizes) == 3 * len(index.quantiser.inner) and index.sizes.sum() == 300
    queries = index.table.filter("id % 50 = 0").select("id", "v")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(index, queries, probes=len(index.sizes), slice_rows=4).collect()]
    assert sorted(got) == sorted(r for r in want if r[0] < 1000)
