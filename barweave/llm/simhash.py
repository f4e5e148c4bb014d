"""SimHash near-duplicates by tiled exact comparison.

Every text's fingerprint is the bitwise majority of its shingles' hashes. Distinct fingerprints are
compared exactly, tile against tile, with numpy's exclusive-or and bit counts; a tile holds fingerprints
of near population counts, and tile pairs whose counts differ beyond the radius are skipped.

All pairs of tiles would be quadratic in the corpus. By the pigeonhole principle two fingerprints
within radius r agree in at least n of r + n bit blocks, so tiles are formed among those that
agree in n: no link is lost, and work falls by the number of the blocks' values. n grows with the table, so that groups don't. A value that
very many fingerprints share is dealt to several tasks, a pair of slices each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, lean, row_chunks, stored, utf8_view, words_of, zipped
from .components import components

BITS = 64
TILE = 1024
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: bit b is set if over half the shingles' XXH64 have it.

    A-Z is lowered; words are runs of bytes other than space and 9 to 13; shingles are joined by one space,
    repeats included. Fewer words than a shingle: the whole sequence is the one shingle; none: zero.
    """
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    starts, ends, row = words_of(data, offsets)
    if len(starts) == 0:
        return out
    # the words of all texts, joined by single spaces
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    line = np.full(int(at[-1] + size[-1]), 0x20, np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(at, size) + place] = _LOWER[data[np.repeat(starts, size) + place]]
    flat = line.tobytes()
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    kept = np.flatnonzero(count)
    many = np.maximum(count[kept] - shingle + 1, 1)
    owner = np.repeat(np.arange(len(kept)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    lead = first[kept][owner] + within
    tail = np.minimum(lead + shingle, (first + count)[kept][owner]) - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    h = np.fromiter((digest(view[a:b], seed) for a, b in zip(at[lead].tolist(), (at + size)[tail].tolist())), np.uint64, len(lead))
    begin = np.cumsum(many) - many
    ones = np.empty((len(kept), BITS), np.int64)
    lanes = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        # eight bits of a byte as eight 16-bit counters in two words would overflow on long texts; unpack instead
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(lanes[:, k : k + 1], axis=1, bitorder="little"), begin, axis=0, dtype=np.int64)
    out[kept] = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


#: The bits of each byte, a byte apiece.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (`count` of them, runs in order): bit b is set if over half have it; no hash: zero."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    pieces = -(-n // 255)  # as many as a byte can count
    first = np.cumsum(pieces) - pieces
    begin = np.repeat((np.cumsum(count) - count)[full] - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
    lanes = h.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(full), BITS), np.int64)
    for k in range(8):
        part = np.add.reduceat(_SPREAD[lanes[:, k]], begin).view(np.uint8).reshape(-1, 8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(part, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty, an empty one has fingerprint zero."""
    ddl = "doc_id long, fp long"
    made = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            parts = [fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle, seed) for a, b in row_chunks(offsets, CHUNK)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield zipped(made, doc_id=batch.column(0), fp=fp.view(np.int64))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), ddl)


def masks(radius: int, agree: int) -> list[int]:
    """Of radius + agree blocks that cover the 64 bits, the bits of every `agree` of them, as signed numbers.

    Fingerprints within the radius differ in `radius` blocks at most, so they are equal under one of the masks.
    """
    edges = [BITS * k // (radius + agree) for k in range(radius + agree + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    sums = [sum(some) for some in combinations(block, agree)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sums]


def agreeing(rows: int, radius: int, slice_rows: int) -> int:
    """The fewest blocks to agree in with which a group of `rows` spread evenly holds `slice_rows` at most; four at most (70 groups a row at radius 4)."""
    return next((n for n in (1, 2, 3) if rows >> (BITS * n // (radius + n)) <= slice_rows), 4)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        """The roots of many nodes, with their paths halved."""
        up = self.up
        at = up[nodes]
        while (up[at] != at).any():
            at = up[at]
        up[nodes] = at
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tiled_links(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius: (place in left, place in right).

    right=None: pairs within left. A forest has the same components as all the pairs and never
    more edges than fingerprints.
    """
    same = right is None
    right = left if same else right
    sides = []
    for fp in (left,) if same else (left, right):
        order = np.argsort(np.bitwise_count(fp), kind="stable")
        sides.append((order, fp[order], np.bitwise_count(fp[order]).astype(np.int16)))
    (lo, lf, lp), (ro, rf, rp) = sides[0], sides[-1]
    forest = Forest(len(left) + (0 if same else len(right)))
    found = []
    for a in range(0, len(lf), tile):
        x, most, least = lf[a : a + tile, None], lp[min(a + tile, len(lf)) - 1], lp[a]
        for b in range(a if same else 0, len(rf), tile):
            if rp[b] - most > radius:
                break  # sorted: all later tiles are farther still
            if least - rp[min(b + tile, len(rf)) - 1] > radius:
                continue
            near = np.bitwise_count(x ^ rf[None, b : b + tile]) <= radius
            if not near.any():
                continue
            # one pair for each two trees that meet: among near copies, nearly all pairs are in one tree already
            mine = forest.roots(lo[a : a + tile])
            other = forest.roots(ro[b : b + tile] + (0 if same else len(left)))
            i, j = np.nonzero(near & (mine[:, None] != other[None, :]))
            _, first = np.unique(mine[i] * len(forest.up) + other[j], return_index=True)
            for p, q in zip(lo[a + i[first]].tolist(), ro[b + j[first]].tolist()):
                if forest.join(p, q if same else len(left) + q):
                    found.append((p, q))
    return found


def links(reps: DataFrame, radius: int = 4, slice_rows: int = 16384, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between representatives whose fingerprints lie within the radius: a spanning set.

    reps: (rep long, fp long), fingerprints distinct. Each row goes to a group for each choice of `agree` blocks. A group of
    more than `slice_rows` rows is dealt into slices by a hash, and each pair of slices is a group of
    its own, so that a task holds two slices at most.
    """
    agree = agree or agreeing(reps.count(), radius, slice_rows)
    keyed = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks(radius, agree))]
    spread = reps.select("rep", "fp", F.explode(F.array(*keyed)).alias("g")).select("rep", "fp", "g.k", "g.v")
    large = spread.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_rows)
    large = large.select("k", "v", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    dealt = spread.join(large, ["k", "v"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    # slice s meets every slice t: the group (min, max)
    dealt = dealt.withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("rep", "fp", "s", F.xxhash64("k", "v", F.least("s", "t"), F.greatest("s", "t")).alias("key"), F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"))
    ddl = "a long, b long"
    made = arrow_schema(ddl)

    def compare(batches):
        """Rows of a key come together, since the partition is sorted by it."""
        held: list[tuple] = []

        def pairs(parts):
            rep, fp, s, key, lo, hi = (np.concatenate(x) for x in zip(*parts))
            a_out, b_out = [], []
            edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
                if b - a < 2:
                    continue
                r, f = rep[a:b], fp[a:b]
                if lo[a] == hi[a]:
                    got = [(r[p], r[q]) for p, q in tiled_links(f, None, radius)]
                else:
                    one = s[a:b] == lo[a]
                    got = [(r[one][p], r[~one][q]) for p, q in tiled_links(f[one], f[~one], radius)]
                a_out += [x for x, _ in got]
                b_out += [y for _, y in got]
            return zipped(made, a=np.array(a_out, np.int64), b=np.array(b_out, np.int64))

        for batch in batches:
            rep, fp, s, key, lo, hi = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut or not held:
                if cut:
                    held.append(tuple(x[:cut] for x in (rep, fp.view(np.uint64), s, key, lo, hi)))
                    yield pairs(held)
                    held = []
                held.append(tuple(x[cut:].copy() for x in (rep, fp.view(np.uint64), s, key, lo, hi)))
            else:
                if held[0][3][0] != key[0]:
                    yield pairs(held)
                    held = []
                held.append(tuple(x.copy() for x in (rep, fp.view(np.uint64), s, key, lo, hi)))
        if held:
            yield pairs(held)

    grouped = dealt.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(lean(compare), ddl)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Documents link if their fingerprints differ in `radius` bits at most; the component is the smallest
    id reachable, the document's own included. Null and empty texts have fingerprint zero and link like any other;
    repeated rows repeat; an empty table gives an empty result; other columns are not read. A row
    with a null id gets its fingerprint, and the component of the rows with ids near it (null if none).
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "representatives")
    found = components(links(reps, radius))
    label = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = prints.join(label, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
