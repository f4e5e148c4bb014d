"""Near-duplicates by SimHash, verified by the exact Jaccard similarity of their shingle sets, without comparing all pairs.

Each set has a SimHash fingerprint. Fingerprints within RADIUS bits are compared as in simhash.py, and what they
link is verified on the whole sets. That alone would lose links: at similarity 0.8 about ten of 64 bits differ, give or
take three, and a radius that loses nothing has no bit blocks left to split by. So candidates also
meet by the shingles themselves. With one order of all shingles, two sets of similarity 0.8 or more share
one among the first n - ceil(0.8 n) + 1 of each (prefix filter), and at the first that they share enough is still to come
behind it (position filter). Both are exact. The order has shingles frequent in a bounded sample last, so
that those which many texts share seldom lead; it changes the work but not the result.

Candidates are verified on the whole sets, in rounds, so that a group of copies makes rows in proportion to its size: first
near fingerprints, and at each leading shingle each set with the smallest one; then each that is still apart from others there meets
a few of them, then a few more (LEADERS), the same at all shingles; what little is apart after that meets in pairs.
Members of a large group that are near to a common text but not to each other stay apart through all rounds. A second
fingerprint rules them out where they meet: bit b of it is the parity of the shingles that hash to b, so two sets differ in
at least as many shingles as these fingerprints do in bits, and those that differ in too many bits can't be near.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _ODD, arrow_schema, discard, lean, mix64, row_chunks, stored, utf8_view, word_hashes, words_of, zipped
from .components import components
from .simhash import _LOWER, links, majority

CHUNK = 1 << 20
#: Similarity NUM / DEN or more is near.
NUM, DEN = 4, 5
SLOTS = 1 << 22
LEADERS = (8, 64)
#: Bits of 64 in which fingerprints may differ that are candidates: the mean at similarity 0.8.
RADIUS = 10
#: Words of 64 bits of a fingerprint of parities.
PARITY = 8
#: Bytes of a shingle's hash by which sets are compared.
WIDE = 6


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each different shingle of each text, rows ascending.

    A-Z is lowered; words are runs of bytes other than space and 9 to 13. Fewer words than a shingle: the whole
    sequence is the one shingle; none: no shingle.
    """
    data = _LOWER[data]
    starts, ends, row = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(count)[row]  # the end of the word's text
    place = np.arange(len(w))
    lead = np.flatnonzero((place + shingle <= last) | ((count[row] < shingle) & (place == last - count[row])))
    h = np.zeros(len(lead), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            inside = lead + k < last[lead]
            h[inside] += mix64(w[lead[inside] + k] + np.uint64(k + 1) * _ODD)
    h, row = mix64(h), row[lead]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    return h[new], row[new]


def _shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return named.filter("id is not null")


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """(hash, row, sizes, keys): the sets, and a hash of each that stands for it (0: the empty set)."""
    h, row = shingles_of(data, offsets, shingle)
    n = np.bincount(row, minlength=len(offsets) - 1)
    keys = np.zeros(len(n), np.uint64)
    if len(h):
        full = np.flatnonzero(n)
        with np.errstate(over="ignore"):
            keys[full] = mix64(np.add.reduceat(mix64(h + _ODD), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
    return h, row, n, keys


def _frequent(named: DataFrame, shingle: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, texts) of the shingles, `most` at most, in three texts or more of a sample, sorted by hash."""
    total = named.count()
    draw = F.pmod(F.xxhash64(F.lit("shingles"), "id"), F.lit(1 << 30))
    sample = named.filter(draw < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))).select("t")
    made = arrow_schema("h long")

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK):
                yield zipped(made, h=shingles_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)[0].view(np.int64))

    counts = sample.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 2")
    got = counts.orderBy(F.desc("c"), "h").limit(most).toPandas()  # `most` rows at most
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int64)[order]


def _prints(h: np.ndarray, row: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The SimHash fingerprint of each set, and behind it the PARITY words of its parities."""
    out = np.zeros((len(n), 1 + PARITY), np.uint64)
    out[:, 0] = majority(h, n)
    word = 1 + ((h >> np.uint64(6)) % np.uint64(PARITY)).astype(np.int64)
    np.bitwise_xor.at(out.reshape(-1), row * (1 + PARITY) + word, np.uint64(1) << (h & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (1 + PARITY)), pa.array(out.view(np.int64).ravel())).cast(kind)


def _leading(named: DataFrame, shingle: int, frequent) -> DataFrame:
    """A row for each text (h null) with its set's key, size and fingerprints, and one for each leading shingle of it with the place."""
    ddl = "id long, key long, n int, h long, place int, print array<long>"
    made = arrow_schema(ddl)
    shipped = named.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known, often = shipped.value
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in row_chunks(offsets, CHUNK):
                h, row, n, keys = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                yield zipped(made, id=ids[a:b], key=keys.view(np.int64), n=n, h=[None] * (b - a), place=[None] * (b - a), print=_prints(h, row, n, made.field("print").type))
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                order = np.lexsort((h, rank, row))
                place = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                new = np.zeros(len(n), bool)
                new[np.unique(keys, return_index=True)[1]] = True  # equal sets of a chunk lead once
                kept = (place < (n - -(-NUM * n // DEN) + 1)[row]) & new[row]
                h, row, place = h[order][kept], row[kept], place[kept]
                yield zipped(made, id=ids[a:b][row], key=keys[row].view(np.int64), n=n[row], h=h.view(np.int64), place=place, print=pa.nulls(len(h), made.field("print").type))

    return named.mapInArrow(lean(run), ddl)


def _whole(named: DataFrame, shingle: int, keys: DataFrame) -> DataFrame:
    """(key, n, grams) of the sets with these keys, once each, and some more. A bitmap of fixed size keeps most other texts from the shuffle."""
    slots = keys.select(F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()  # SLOTS rows at most
    bitmap = np.zeros(SLOTS, bool)
    bitmap[slots["slot"].to_numpy()] = True
    shipped = named.sparkSession.sparkContext.broadcast(np.packbits(bitmap))
    ddl = "key long, n int, grams binary"
    made = arrow_schema(ddl)

    def run(batches):
        open_ = np.unpackbits(shipped.value).astype(bool)
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                h, _, n, keys = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                keys = keys.view(np.int64)
                _, first = np.unique(keys, return_index=True)
                first = first[open_[keys[first] % SLOTS] & (n[first] > 0)]
                ends = np.cumsum(n)
                grams = h.view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :]  # the high bytes, by which the sets are sorted
                yield zipped(made, key=keys[first], n=n[first], grams=[grams[ends[i] - n[i] : ends[i]].tobytes() for i in first.tolist()])

    return named.mapInArrow(lean(run), ddl).dropDuplicates(["key"])


def _verified(named: DataFrame, shingle: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets have similarity NUM / DEN or more."""
    two = _whole(named, shingle, pairs.select(F.col("b").alias("key"))).toDF("b", "nb", "gb")
    one = _whole(named, shingle, pairs.select(F.col("a").alias("key"))).toDF("a", "na", "ga")
    ddl = "a long, b long"
    made = arrow_schema(ddl)

    def grams(blob) -> np.ndarray:
        wide = np.zeros((len(blob) // WIDE, 8), np.uint8)
        wide[:, :WIDE] = np.frombuffer(blob, np.uint8).reshape(-1, WIDE)
        return wide.view(np.uint64).ravel()

    def run(batches):
        for batch in batches:
            cols = [batch.column(x) for x in ("na", "nb", "ga", "gb")]
            near = [(NUM + DEN) * len(np.intersect1d(grams(x.as_buffer()), grams(y.as_buffer()), assume_unique=True)) >= NUM * (m.as_py() + n.as_py()) for m, n, x, y in zip(*cols)]
            kept = pa.array(near, pa.bool_())
            yield zipped(made, a=batch.column("a").filter(kept), b=batch.column("b").filter(kept))

    return stored(pairs.join(two, "b").join(one, "a").mapInArrow(lean(run), ddl), "links")


def _able(na, at_a, nb, at_b):
    """Whether a shared shingle and what may follow it in both sets can make up the overlap that the similarity takes."""
    return (NUM + DEN) * F.least(na - at_a, nb - at_b) >= NUM * (na + nb)


def _alike(na, one, nb, two):
    """Whether the parities of two sets differ in no more bits than the sets may in shingles."""
    apart = reduce(Column.__add__, [F.bit_count(one[k].bitwiseXOR(two[k])) for k in range(1, 1 + PARITY)])
    return (NUM + DEN) * apart <= (DEN - NUM) * (na + nb)


def _close(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints lie within RADIUS bits: a spanning set of them."""
    prints = reps.filter("n > 0").select("key", F.col("print")[0].alias("fp"))
    first = stored(prints.groupBy("fp").agg(F.min("key").alias("rep")), "fingerprints")
    equal = prints.join(first, "fp").filter("key != rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    near = links(first.select("rep", "fp"), RADIUS)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(equal)


def _apart(met: DataFrame, found: list[DataFrame], reps: DataFrame) -> DataFrame:
    """Rows of shingles at which sets of different components still meet, with their fingerprints and the component as `of`."""
    label = components(reduce(DataFrame.unionAll, found))
    own = Window.partitionBy("h")
    rows = met.join(label, met["key"] == label["node"], "left").withColumn("of", F.coalesce("component", met["key"]))
    rows = rows.withColumn("lo", F.min("of").over(own)).withColumn("hi", F.max("of").over(own)).filter("lo < hi")
    if "print" not in met.columns:
        rows = rows.join(reps.select("key", "print"), "key")
    return stored(rows.select("h", "key", "n", "place", "print", "of"), "apart")


def _meetings(x: DataFrame, y: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The pairs of different components that can be near and haven't been verified."""
    x, y = x.toDF("h", "a", "na", "pa", "fa", "oa"), y.toDF("h", "b", "nb", "pb", "fb", "ob")
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    enough = _able(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")) & _alike(F.col("na"), F.col("fa"), F.col("nb"), F.col("fb"))
    met = x.join(y, "h").filter((F.col("oa") != F.col("ob")) & enough).select(*ends).distinct()
    return stored(met.join(reduce(DataFrame.unionAll, done), ["a", "b"], "left_anti"), "pairs")


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, sample_rows: int = 20000) -> DataFrame:
    """(doc_id): the smallest id of each group of texts that similarity 0.8 or more connects.

    Similarity is that of the sets of word shingles. Texts without a word (null ones too) are alike. Rows of one id
    count as one document; rows without id take no part; an empty table gives an empty result.
    """
    named = _shingled(docs, id_col, text_col)
    made = stored(_leading(named, shingle, _frequent(named, shingle, sample_rows, 1 << 17)), "shingles")
    reps = stored(made.filter("h is null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("print").alias("print")), "representatives")
    own = Window.partitionBy("h")
    met = made.filter("h is not null").select("h", "key", "n", "place").repartition("h").dropDuplicates(["h", "key"])
    met = met.withColumn("lead", F.min(F.struct("key", "n", "place")).over(own)).withColumn("c", F.count(F.lit(1)).over(own)).filter("c > 1")
    met = stored(met.select("h", "key", "n", "place", "lead"), "shared-shingles")
    discard(made)
    # a pair that only passes at another shingle is met again below
    near = met.filter((F.col("key") != F.col("lead.key")) & _able(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place")))
    pairs = [stored(near.select(F.col("lead.key").alias("a"), F.col("key").alias("b")).unionAll(_close(reps)).distinct(), "pairs")]
    found = [_verified(named, shingle, pairs[0])]
    apart = met.drop("lead")
    for leaders in (*LEADERS, None):
        apart = _apart(apart.drop("of"), found, reps)  # what is apart later is so now: sets only join
        first = Window.partitionBy("h").orderBy(F.xxhash64("key"), "key")
        led = apart.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= leaders).drop("r") if leaders else apart
        pairs.append(_meetings(apart, led, pairs))
        found.append(_verified(named, shingle, pairs[-1]))
    to = lambda name: reps.select(F.col("key").alias(name), F.col("rep").alias(f"r{name}"))
    group = components(reduce(DataFrame.unionAll, found).join(to("a"), "a").join(to("b"), "b").select("ra", "rb"))
    root = reps.select("rep").distinct().join(group, F.col("rep") == F.col("node"), "left").filter(F.coalesce("component", "rep") == F.col("rep"))
    return stored(root.select(F.col("rep").alias("doc_id")), "kept-ids")
