"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Items are dealt to shards by a hash of their id (copies of a text and documents of a source spread out
with them), and each shard packs its own: largest first, each into the open bin with the
smallest residual that still takes it. Bins are kept in residual order and carry a bitmap of sources and one
of duplicate clusters; where the tightest bin conflicts, the search goes on to its successors.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, arrow_schema, zipped


class BestFit:
    """The open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.bits: dict = {}

    def bit(self, kind: int, value) -> int:
        """The bitmap of one source or cluster; null conflicts with nothing."""
        return 0 if value is None else 1 << self.bits.setdefault((kind, value), len(self.bits))

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset) of an item; opens a bin if no open one is large enough and free of conflicts."""
        s, c = self.bit(0, source), self.bit(1, cluster)
        order, sources, clusters = self.order, self.sources, self.clusters
        for i in range(bisect_left(order, (size, -1)), len(order)):
            residual, b = order[i]
            if not (sources[b] & s or clusters[b] & c):
                del order[i]
                break
        else:
            residual, b = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(order, (residual - size, b))
        return b, self.capacity - residual


PLACED = "id long, piece int, first_word long, n_words int, shard int, bin_id long, bin_offset int"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster: Column | None = None, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """One row per piece: its document, first word and length, and its bin and place there.

    A document longer than a bin is cut into pieces of `capacity` words, which fill bins of their own,
    and a rest that is packed like any other. A bin has no two pieces of one source, nor of
    one duplicate cluster (by default: of equal texts); null sources don't conflict. A null or empty
    text is a piece of no words. Ties go by id, then piece; repeated rows are packed once each. Only ids and
    sizes are shuffled, and a task holds one shard (about `shard_rows` items).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"),
        (F.lit(None) if source_col is None else F.col(source_col)).cast("string").alias("source"),
        (F.xxhash64(text) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    last = F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity)).cast("int")
    items = items.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = items.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), F.least(F.lit(capacity), F.col("words") - F.col("piece").cast("long") * capacity).cast("int").alias("n_words"), "source", "cluster")
    shards = max(1, -(-docs.count() // shard_rows))  # counted from file footers where docs is a table
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt = keyed.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "id", "piece", "source", "cluster")
    made = arrow_schema(PLACED)

    def run(batches):
        shard, bins = None, None
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(("id", "piece", "first_word", "n_words", "source", "cluster", "shard"))}
            where, offset = [], []
            for size, source, own, at in zip(cols["n_words"], cols["source"], cols["cluster"], cols["shard"]):
                if at != shard:
                    shard, bins = at, BestFit(capacity)
                b, o = bins.place(size, source, own)
                where.append((at << 32) + b)
                offset.append(o)
            yield zipped(made, bin_id=where, bin_offset=offset, **{n: batch.column(k) for k, n in enumerate(("id", "piece", "first_word", "n_words"))}, shard=batch.column(6))

    return dealt.mapInArrow(run, PLACED).withColumnRenamed("id", id_col)

