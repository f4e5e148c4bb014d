"""A quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each vocabulary entry has a fixed sparse random index vector; its word vector is that vector plus the
index vectors of the words seen near it. A text's vector is the mean over its tokens; a network with one
hidden layer, trained in numpy, gives a logit, and a temperature fitted on rows that it wasn't trained on
turns logits into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, give_back, lean, mix64, row_chunks, utf8_view, word_hashes, zipped

SLOTS = 1 << 16
SHAPES = 16  # ids of words outside the vocabulary, by shape
REPEAT = SHAPES  # a token equal to the one before it
SPECIALS = SHAPES + 1
#: Bytes of text at a time; each token gathers a vector.
CHUNK = 1 << 18
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[0x80:] = 1
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_a:_b] = 1
_KIND[0x30:0x3A] = 2


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """(hash, shape, row) of each token: a run of letters, a run of digits or one other byte."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    kind = _KIND[data]
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    cuts = offsets[1:-1]
    first[cuts[cuts < n]] = True
    edges = np.flatnonzero(first)
    ends = np.append(edges[1:], n)
    real = kind[edges] != 0
    starts, ends = edges[real], ends[real]
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    rows = np.searchsorted(offsets, starts, "right") - 1
    capital = (data >= 0x41) & (data <= 0x5A)
    held = np.concatenate([[0], np.cumsum(capital)])
    caps, size = held[ends] - held[starts], ends - starts
    written = np.where(caps == 0, 0, np.where((caps == 1) & capital[starts], 1, np.where(2 * caps >= size, 2, 3)))
    shape = np.where(kind[starts] == 1, written * 3 + np.minimum(size // 6, 2), 11 + kind[starts])
    return word_hashes(data, starts, ends), shape, rows


def index_vectors(n: int, width: int, ones: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the sparse ternary index vectors of ids 0..n-1, from a hash of the id."""
    h = mix64(np.arange(n * ones, dtype=np.uint64) + np.uint64(0xA5A5)).reshape(n, ones)
    return (h % np.uint64(width)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


@dataclass
class Vocabulary:
    """The most frequent tokens; a slot table gives each one's id in one lookup."""

    slot_hash: np.ndarray
    slot_id: np.ndarray
    size: int

    @staticmethod
    def build(hashes: np.ndarray) -> Vocabulary:
        """hashes: most frequent first. Of two in one slot the more frequent stays."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        _, kept = np.unique(slot, return_index=True)
        table, ids = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int64)
        table[slot[kept]], ids[slot[kept]] = hashes[kept], SPECIALS + kept
        return Vocabulary(table, ids, SPECIALS + len(hashes))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, row) of each token of the texts."""
        h, shape, rows = tokens_of(data, offsets)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.where((self.slot_id[slot] >= 0) & (self.slot_hash[slot] == h), self.slot_id[slot], shape)
        if len(h) > 1:
            out[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])] = REPEAT
        return out, rows


@dataclass
class QualityModel:
    words: Vocabulary
    vectors: np.ndarray
    layers: tuple
    temperature: float

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean word vector of each text; zeros without tokens."""
        out = np.zeros((len(offsets) - 1, self.vectors.shape[1]), np.float32)
        ids, rows = self.words.ids(data, offsets)
        if len(ids):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            sizes = np.diff(np.append(starts, len(rows)))
            for a in range(0, len(starts), 256):  # bounds the gathered vectors
                own = starts[a : a + 256]
                lo, hi = own[0], own[-1] + sizes[min(a + 255, len(starts) - 1)]
                for s, m, r in zip(own, sizes[a : a + 256], rows[own]) if hi - lo > 1 << 18 else ():
                    out[r] = sum(self.vectors[ids[k : min(k + (1 << 17), s + m)]].sum(0, dtype=np.float64) for k in range(s, s + m, 1 << 17)) / m
                if hi - lo <= 1 << 18:
                    out[rows[own]] = np.add.reduceat(self.vectors[ids[lo:hi]], own - lo, axis=0) / sizes[a : a + 256, None]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [logits(self.layers, self.pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in row_chunks(offsets, CHUNK)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(z / self.temperature, -500, 500)))


def logits(layers, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7):
    """The two layers by Adam on cross-entropy, mini-batches of 128."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            own = order[a : a + 128]
            h = np.tanh(x[own] @ p[0] + p[1])
            z = np.clip(h @ p[2] + p[3], -30, 30)
            g = (1 / (1 + np.exp(-z)) - y[own]) / len(own)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [x[own].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum()]
            step += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (mean, scale, *p)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the logits' cross-entropy is least (a fine grid of its logarithm)."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 120))
    loss = [np.logaddexp(0, -(2 * y - 1) * z / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = 8000, vocabulary: int = 8192, width: int = 64, window: int = 2) -> QualityModel | float:
    """Learn from at most `sample_rows` labelled rows among those where `learn` (over column i) holds.

    The rows are those with the smallest hash of the id. The driver gets, of them, their pooled vectors, and
    besides the vocabulary's counts and word vectors: all of fixed size. With no label, or labels of
    one kind only, the result is the share of label 1 (0.5 without any), to be used as the score. A document's
    contradicting labels are averaged and count as 1 from one half up.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y")).filter(learn & F.col("i").isNotNull() & F.col("y").isNotNull())
    marked = marked.groupBy("i").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    draw = F.xxhash64(F.lit("quality"), "i")
    chosen = marked.orderBy(draw, "i").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(chosen), "i").select("i", "t", "y").persist()  # `chosen` has sample_rows rows at most
    try:
        kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(kinds) < 2:
            return next(iter(kinds), 0.5)

        ddl = "h long, n long"
        made = arrow_schema(ddl)

        def count(batches):
            for batch in batches:
                data, offsets = utf8_view(batch.column(1))
                for a, b in row_chunks(offsets, CHUNK):
                    h, n = np.unique(tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True)
                    yield zipped(made, h=h.view(np.int64), n=n)

        top = rows.mapInArrow(lean(count), ddl).groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(vocabulary).toPandas()
        words = Vocabulary.build(top["h"].to_numpy(np.int64).view(np.uint64))
        held = spark.sparkContext.broadcast(words)
        ddl2 = "id long, v array<float>"
        made2 = arrow_schema(ddl2)

        def contexts(batches):
            own = held.value
            place, sign = index_vectors(own.size, width)
            total = np.zeros(own.size * width)
            for batch in batches:
                data, offsets = utf8_view(batch.column(1))
                for a, b in row_chunks(offsets, CHUNK):
                    ids, row = own.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    for step in range(1, window + 1):
                        near = row[step:] == row[:-step]
                        left, right = ids[:-step][near], ids[step:][near]
                        for x, c in ((left, right), (right, left)):
                            for k in range(place.shape[1]):
                                total += np.bincount(x * width + place[c, k], sign[c, k], own.size * width)
            full = total.reshape(-1, width)
            seen = np.flatnonzero(np.abs(full).sum(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * width, pa.int32()), pa.array(full[seen].ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), flat.cast(made2.field(1).type)], schema=made2)

        sums = rows.mapInArrow(lean(contexts), ddl2).groupBy("id").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect()
        vectors = np.zeros((words.size, width))
        for r in sums:
            vectors[r["id"]] = r["v"]
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors /= np.maximum(size, 1e-9)
        place, sign = index_vectors(words.size, width)
        for k in range(place.shape[1]):
            vectors[np.arange(words.size), place[:, k]] += sign[:, k] * 0.5
        model = QualityModel(words, vectors.astype(np.float32), (), 1.0)
        shipped = spark.sparkContext.broadcast(model)
        ddl3 = "i long, y double, x array<float>"
        made3 = arrow_schema(ddl3)

        def pool(batches):
            own = shipped.value
            for batch in batches:
                data, offsets = utf8_view(batch.column(1))
                x = np.concatenate([own.pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets, CHUNK)]) if batch.num_rows else np.zeros((0, width), np.float32)
                yield zipped(made3, i=batch.column(0), y=batch.column(2), x=list(x))

        got = rows.withColumn("i", F.col("i").cast("long")).mapInArrow(lean(pool), ddl3).toPandas().sort_values(["i", "y"])
        x, y = np.stack(got["x"].to_numpy()).astype(float), got["y"].to_numpy(float)
        aside = mix64(got["i"].to_numpy(np.int64).view(np.uint64)) % np.uint64(5) == 0
        if aside.all() or len(set(y[~aside])) < 2:
            aside[:] = False
        layers = train(x[~aside], y[~aside])
        return QualityModel(words, vectors.astype(np.float32), layers, temperature(logits(layers, x[aside]), y[aside]))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: QualityModel | float, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with the probability of label 1 (a null or empty text gets that of no tokens). No shuffle."""
    if not isinstance(model, QualityModel):
        return docs.withColumn(out_col, F.lit(float(model)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(held.value.score(*utf8_view(pa.array(texts, pa.large_string()))))
        give_back()

    return docs.withColumn(out_col, probability(F.col(text_col).cast("string")))


def document_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score every text, learning from labels outside the held-out fold (crc32(doc_id) mod 4 is 2)."""
    model = fit(docs, labels, fold(F.col("i"), 4) != 2)
    picked = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    return score(picked, model, out_col="score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
