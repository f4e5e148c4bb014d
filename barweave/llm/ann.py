"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Coarse centroids and sub-quantisers are fitted on a bounded sample; every vector is then assigned to the
list of its nearest centroid and its residual is coded in a few bytes. A query visits the lists of its
nearest centroids, scores their codes with a table of its own inner products (asymmetric distances),
and the best of them are ranked anew with the original vectors in double precision. So is every other row whose
code, with its own error as a bound, doesn't rule out that it belongs to them; within the lists visited the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, stored, zipped


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids; an emptied cluster restarts at a random point. k is cut to the number of points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centers * centers).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + step] @ centers.T - half, 1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    """Coarse centroids in two levels, and for each stretch of dimensions the residuals' centroids.

    A list is a coarse centroid and one of the `inner` centroids of all residuals, so that a few thousand centroids make
    as many lists as the table needs.
    """

    outer: np.ndarray
    inner: np.ndarray
    books: list[np.ndarray]
    stretches: list[tuple[int, int]]

    @property
    def centers(self) -> np.ndarray:
        """The centre of each list."""
        return (self.outer[:, None, :] + self.inner[None, :, :]).reshape(-1, self.outer.shape[1])

    @staticmethod
    def fit(x: np.ndarray, lists: int, inner: int, parts: int, codes: int) -> Quantiser:
        d = x.shape[1]
        parts = max(1, min(parts, d))
        edges = [d * k // parts for k in range(parts + 1)]
        outer = kmeans(x, lists)
        rest = x - outer[nearest(x, outer)]
        within = kmeans(rest, inner, seed=5) if inner > 1 else np.zeros((1, d))
        rest = rest - within[nearest(rest, within)]
        cuts = list(zip(edges, edges[1:]))
        return Quantiser(outer, within, [kmeans(rest[:, a:b], codes, seed=11 + a) for a, b in cuts], cuts)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and what its centre leaves of it."""
        own = nearest(x, self.outer)
        rest = x - self.outer[own]
        within = nearest(rest, self.inner)
        return own * len(self.inner) + within, rest - self.inner[within]

    def center(self, of: int) -> np.ndarray:
        return self.outer[of // len(self.inner)] + self.inner[of % len(self.inner)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, rest = self.assign(x)
        return own, np.stack([nearest(rest[:, a:b], book).astype(np.uint8) for (a, b), book in zip(self.stretches, self.books)], 1)

    def approximate(self, q: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of every query with every coded vector of one list, from distance tables."""
        out = np.repeat((q @ self.center(center))[:, None], len(codes), 1)
        for m, ((a, b), book) in enumerate(zip(self.stretches, self.books)):
            out += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return out

    def loss(self, x: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """How far each vector of one list lies from what its code stands for: no unit query's inner product with it is off by more."""
        rest = x - self.center(center)
        for m, ((a, b), book) in enumerate(zip(self.stretches, self.books)):
            rest[:, a:b] -= book[codes[:, m]]
        return np.sqrt((rest * rest).sum(1))


def usable(col: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return col.isNotNull() & finite & F.exists(col, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares stay finite; that rounds nothing and changes no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Index:
    """`table`: id, list, codes, v of every usable vector; `sizes`: rows of each list; `probes`: lists to visit."""

    quantiser: Quantiser
    table: DataFrame
    sizes: np.ndarray
    probes: int


def probes_for(x: np.ndarray, model: Quantiser, recall: float, k: int = 5, queries: int = 256) -> int:
    """The fewest lists whose visit finds `recall` of the sample's own k nearest pairs.

    The whole table is denser than the sample, its nearest rows are nearer and more often in the first
    lists, so the estimate errs on the safe side.
    """
    q = x[: min(queries, len(x))]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-near, 1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return 1
    order = np.argsort(-(q @ model.centers.T), 1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    needed = np.sort(np.take_along_axis(place, model.assign(x)[0][top], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def vectors_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of all usable vectors with an id, one for each id: of several the one whose components come first in order."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    if again.isEmpty():  # only ids were shuffled
        return rows
    again = stored(again, "repeated-ids")
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> Index | None:
    """Index all usable vectors of the most frequent length (the shorter, on a tie); see `fit`. None without any."""
    rows = vectors_of(vectors, id_col, vec_col)
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return None if found is None else fit(rows.filter(F.size("v") == found["d"]), found["n"], **settings)


def fit(rows: DataFrame, size: int, sample_rows: int = 20000, lists: int | None = None, list_rows: int = 4096, parts: int = 16, codes: int = 256, recall: float = 0.98) -> Index:
    """Index `size` rows (id, v) of equal length. Fitted on the `sample_rows` rows at most with the smallest id hash.

    By default as many coarse centroids as half the root of the number of rows, 1024 at most, and as many inner ones (256 at most)
    as leave about `list_rows` rows to a list.
    """
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near_enough = rows.filter(draw < int(min(1.0, 1.2 * sample_rows / size) * (1 << 30)))  # so that no more reaches the driver
    sample = near_enough.orderBy(draw, "id").limit(sample_rows).select("v").toPandas()
    if not len(sample):  # a small table without a row in that range
        sample = rows.orderBy(draw, "id").limit(sample_rows).select("v").toPandas()
    x = unit(np.stack(sample["v"].to_numpy()).astype(np.float64))
    lists = lists or max(1, min(1024, round(size**0.5 / 2)))
    model = Quantiser.fit(x, lists, max(1, min(256, -(-size // (lists * list_rows)))), parts, codes)
    held = rows.sparkSession.sparkContext.broadcast(model)
    ddl = "id long, list int, codes binary, v array<double>"
    made = arrow_schema(ddl)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                own, coded = held.value.encode(unit(matrix(batch.column(1))))
                yield zipped(made, id=batch.column(0), list=own, codes=[c.tobytes() for c in coded], v=batch.column(1).cast(made.field("v").type))

    table = stored(rows.mapInArrow(assign, ddl), "ivf")
    sizes = np.zeros(len(model.outer) * len(model.inner), np.int64)
    for r in table.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    return Index(model, table, sizes, probes_for(x, model, recall))


def search(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None, rerank: int = 128, slice_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, its own id left out.

    queries: (id, v), usable. A query visits `probes` lists, and more until they hold more than k rows.
    List and queries meet in groups (list, slice of the list, slice of its queries) of bounded size, so neither
    a hot list nor many queries burden one task; a row is copied only as often as the queries of its own list have slices. Of each group, `rerank` rows are scored first and then all that their
    codes don't exclude.
    """
    spark, probes = queries.sparkSession, probes or index.probes
    held = spark.sparkContext.broadcast((index.quantiser, index.sizes))
    visits = "query_id long, list int, q array<double>"
    made = arrow_schema(visits)

    def visit(batches):
        model, sizes = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            centers = model.centers
            for a in range(0, batch.num_rows, step := max(1, (1 << 22) // len(centers))):
                part = batch.slice(a, step)
                q = unit(matrix(part.column(1)))
                order = np.argsort(-(q @ centers.T), 1, kind="stable")
                many = (np.cumsum(sizes[order], 1) <= k).sum(1) + 1
                many = np.minimum(np.maximum(many, probes), order.shape[1])
                which = np.repeat(np.arange(len(q)), many)
                lists = order[which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
                yield zipped(made, query_id=part.column(0).take(pa.array(which)), list=lists, q=part.column(1).cast(made.field("q").type).take(pa.array(which)))

    asked = stored(queries.mapInArrow(visit, visits), "visits")
    per_list = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("q_slices"))  # a row a list
    per_list = stored(per_list.join(index.table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("l_slices")), "list"), "list-slices")
    asked = asked.join(per_list, "list").withColumn("qs", F.pmod(F.xxhash64("query_id"), F.col("q_slices")).cast("int"))
    asked = asked.withColumn("ls", F.explode(F.sequence(F.lit(0), F.col("l_slices") - 1))).drop("q_slices", "l_slices")
    rows = index.table.join(per_list, "list").withColumn("ls", F.pmod(F.xxhash64("id"), F.col("l_slices")).cast("int"))
    rows = rows.withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("q_slices") - 1))).select("id", "list", "codes", "v", "ls", "qs")
    ddl = "query_id long, vec_id long, score double"
    out = arrow_schema(ddl)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        model = held.value[0]
        col = lambda t, n: t.column(n).combine_chunks()
        ids, v = col(left, "id").to_numpy(), scaled(matrix(col(left, "v")))
        coded = np.frombuffer(b"".join(col(left, "codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        qid, q = col(right, "query_id").to_numpy(), scaled(matrix(col(right, "q")))
        length = np.sqrt((v * v).sum(1))
        center = col(left, "list")[0].as_py()
        loss = np.concatenate([model.loss(unit(v[a : a + 4096]), center, coded[a : a + 4096]) for a in range(0, len(ids), 4096)]) + 1e-9  # and rounding

        def exact(rows, own_id, own):
            rows = rows[ids[rows] != own_id]
            return rows, (v[rows] * own).sum(1) / (length[rows] * np.sqrt((own * own).sum()))

        got = [[], [], []]
        step = max(1, (1 << 21) // len(ids))
        for a in range(0, len(qid), step):
            rough = model.approximate(unit(q[a : a + step]), center, coded)
            rough[qid[a : a + step, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-rough, rerank - 1, 1)[:, :rerank] if rerank < len(ids) else np.tile(np.arange(len(ids)), (len(rough), 1))
            for i, near in enumerate(top):
                near, score = exact(near, qid[a + i], q[a + i])
                if rerank < len(ids):
                    # no row whose code could hide a score as high as the k-th so far is left out: ties and copies come in whole
                    least = np.partition(score, len(score) - k)[-k] if len(score) >= k else -np.inf
                    near, score = exact(np.union1d(near, np.flatnonzero(rough[i] + loss >= least)), qid[a + i], q[a + i])
                best = np.lexsort((ids[near], -score))[:k]
                got[0].append(np.full(len(best), qid[a + i]))
                got[1].append(ids[near][best])
                got[2].append(score[best])
        return pa.table([pa.array(np.concatenate(x), f.type) for x, f in zip(got, out)], schema=out)

    keys = ["list", "ls", "qs"]
    near = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, ddl)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`; empty without usable vectors.

    Vectors are compared with those of their own length, since others have no cosine with them. Null ids take no part; rows
    of one id count as one vector (`vectors_of`). Other columns are not read.
    """
    rows = vectors_of(vectors)
    found = []
    for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row a length
        index = fit(rows.filter(F.size("v") == r["d"]), r["n"])
        found.append(search(index, index.table.filter(F.col("id") % every == 0).select("id", "v"), k))
    return reduce(DataFrame.unionAll, found, vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"))
