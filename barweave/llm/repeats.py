"""Repeated windows of a whole corpus: the distributed frame of both substring operators.

Anchors of all documents meet by hash, once for some 8 MB of text that repeats them; classes of equal context are
settled by counting. Of what is left, one representative per class brings its symbols to a shard, where the operator's own index
(a family of suffix arrays, or reference blocks of a relative Lempel-Ziv parse) finds the windows that repeat.
An anchor with more contexts than a shard should hold is cut by content (`split`), as often as it takes, and its
parts go the same way. All tables between are in the shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .common import arrow_schema, discard, lean, row_chunks, stored, utf8_view, word_hashes, words_of, zipped

CHUNK = 1 << 18
#: Bytes of text whose runs a task combines before they are shuffled.
COMBINE = 8 << 20
#: Bytes of contexts that an index sees at once, and that a task works through, about.
SHARD_BYTES, TASK_BYTES = 2 << 20, 64 << 20
#: How finely `split` cuts, round by round.
STEPS = {"bytes": (64, 16, 4, 1), "words": (4, 1)}
#: Most contexts of an anchor that a shard takes; more are split by content.
MOST_CONTEXTS = 1 << 14
#: Joins and groups on a row of the corpus use both of its hashes, 96 bits.
ROW = ["uid", "u2"]


def symbols_of(kind: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's symbols and where rows begin among them: its bytes, or a hash for each word."""
    if kind == "bytes":
        return data, offsets
    starts, ends, row = words_of(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def row_hashes(doc: Column, text: Column) -> list[Column]:
    """The two hashes that tell rows apart even where ids repeat or are null; rows equal in id and text share them."""
    doc, text = doc.cast("long"), F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(doc, text), F.hash(text, doc)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, u2, doc, text) of every row."""
    uid, u2 = row_hashes(F.col(id_col), F.col(text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(uid.alias("uid"), u2.alias("u2"), F.col(id_col).cast("long").alias("doc"), text.alias("text"))


def classed(a: np.ndarray, c: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, many, of): for each class of equal anchor and context its run of least place and its size; the class of each run."""
    order = np.lexsort((*place[::-1], c, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1]))
    begin = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[begin], np.diff(np.append(begin, len(order))), of


def anchor_table(rows: DataFrame, kind: str, window: int, gram: int, keep_first: bool) -> DataFrame:
    """Classes of runs of windows with one anchor, as far as COMBINE bytes of text hold them, and what repeats there already.

    A class: the document, anchor, context, lo, n (windows), d (anchor's distance) of its first run, and many (runs). Spans of
    windows that are seen to repeat without the rest of the corpus have no anchor, but begin at lo and have n symbols.
    """
    ddl = "uid long, u2 int, doc long, a long, c long, lo int, n int, d int, many int"
    made = arrow_schema(ddl)

    def combined(parts):
        a, c, lo, n, d, uid, u2, known, doc, row = (np.concatenate(x) for x in zip(*parts))
        least, many, of = classed(a, c, known, doc, uid, u2, lo)
        own = {"uid": uid[least], "u2": u2[least], "doc": pa.array(doc[least], mask=~known[least])}
        yield zipped(made, **own, a=a[least].view(np.int64), c=c[least].view(np.int64), lo=lo[least], n=n[least], d=d[least], many=many)
        again = many[of] > 1
        if keep_first:
            of = least[of]
            again &= (known != known[of]) | (doc != doc[of]) | (uid != uid[of]) | (u2 != u2[of]) | (lo != lo[of])
        at = np.flatnonzero(again)
        if not len(at):
            return
        # runs come in order of row and place; those that touch are one span
        s, e = lo[at], lo[at] + n[at] - 1 + window
        new = np.append(True, (row[at][1:] != row[at][:-1]) | (s[1:] > e[:-1]))
        last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        none = pa.nulls(int(new.sum()), pa.int64())
        at = at[new]
        yield zipped(made, uid=uid[at], u2=u2[at], doc=pa.array(doc[at], mask=~known[at]), a=none, c=none, lo=s[new], n=e[last] - s[new], d=none, many=none)

    def run(batches):
        parts, size, seen = [], 0, 0
        for batch in batches:
            data, offsets = utf8_view(batch.column(3))
            uid, u2 = (batch.column(k).to_numpy() for k in (0, 1))
            known, doc = batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy()
            for x, y in row_chunks(offsets, CHUNK):
                symbols, at = symbols_of(kind, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                a, c, row, lo, hi, place = runs(symbols, at, window, gram)
                size += int(offsets[y] - offsets[x])
                if len(a):
                    row += x
                    parts.append((a, c, lo, hi - lo + 1, place - lo, uid[row], u2[row], known[row], doc[row], row + seen))
                if size >= COMBINE and parts:
                    yield from combined(parts)
                    parts, size = [], 0
            seen += batch.num_rows
        if parts:
            yield from combined(parts)

    return rows.mapInArrow(lean(run), ddl)


def packed(rows: DataFrame) -> DataFrame:
    """rows with their text compressed, for shuffles."""
    ddl = "uid long, u2 int, doc long, z binary"
    made = arrow_schema(ddl)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield zipped(made, uid=batch.column(0), u2=batch.column(1), doc=batch.column(2), z=[squeeze(t.as_buffer()) for t in batch.column(3)])

    return rows.mapInArrow(lean(run), ddl)


CONTEXT = "a long, uid long, u2 int, doc long, lo int, n int, d int, many long, ctx binary"


def contexts(rows: DataFrame, reps: DataFrame, kind: str, window: int) -> DataFrame:
    """The representatives with their symbols (CONTEXT; many: occurrences of the class), each once where rows repeat."""
    wanted = reps.groupBy(*ROW).agg(F.collect_list(F.struct("a", "lo", "n", "d", "many")).alias("w"))
    made = arrow_schema(CONTEXT)

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            names = ("a", "lo", "n", "d", "many")
            *own, z, w = batch.columns
            for i in range(batch.num_rows):
                raw = np.frombuffer(grow(z[i].as_py()), np.uint8)
                symbols, _ = symbols_of(kind, raw, np.array([0, len(raw)]))
                flat = w.slice(i, 1).flatten()
                part = dict(zip((f.name for f in flat.type), flat.flatten()))
                lo, n = part["lo"].to_numpy(), part["n"].to_numpy()
                ctx = [symbols[x : x + k - 1 + window].tobytes() for x, k in zip(lo.tolist(), n.tolist())]
                twice = pa.array(np.full(len(lo), i))
                yield zipped(made, **{k: part[k] for k in names}, **{k: c.take(twice) for k, c in zip(("uid", "u2", "doc"), own)}, ctx=ctx)

    joined = packed(rows).join(wanted, ROW).dropDuplicates(ROW).select(*ROW, "doc", "z", "w")
    return joined.mapInArrow(lean(run), CONTEXT)


#: kernel(contexts, anchors, distances, window): for all windows of all contexts in order, whether they repeat.
Kernel = Callable[[list[np.ndarray], np.ndarray, np.ndarray, int], np.ndarray]
SPAN = "uid long, u2 int, s int, e int"


def shard_spans(found: DataFrame, size: int, kind: str, window: int, kernel: Kernel, all_rows: bool) -> DataFrame:
    """The spans of repeated windows among the contexts that meet in a shard.

    Shards are dealt by anchor, so that contexts of one never part; in a shard they come in order of document and
    place. A task works through many shards. size: bytes of all contexts, about. all_rows: whether classes of several
    occurrences, already settled, are asked too.
    """
    made = arrow_schema(SPAN)
    width = np.uint8 if kind == "bytes" else np.uint64
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    shards = max(8 * tasks, -(-size // SHARD_BYTES))

    def judged(batches):
        held = pa.Table.from_batches(batches)
        lo, n, d, many, a = (held.column(x).to_numpy() for x in ("lo", "n", "d", "many", "a"))
        repeats = kernel([np.frombuffer(x.as_buffer(), width) for x in held.column("ctx")], a, d, window)
        row = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(repeats & (all_rows | (many[row] == 1)))
        if len(at):
            place = lo[row[at]] + at - (np.cumsum(n) - n)[row[at]]
            new = np.append(True, (np.diff(at) != 1) | (np.diff(row[at]) != 0))
            last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
            of = pa.array(row[at[new]])
            yield zipped(made, uid=held.column("uid").combine_chunks().take(of), u2=held.column("u2").combine_chunks().take(of), s=place[new], e=place[last] + window)

    def run(batches):
        held, at = [], None
        for batch in batches:
            shard = batch.column(batch.num_columns - 1).to_numpy()
            edges = np.flatnonzero(np.diff(shard, prepend=-1))
            for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)]):
                if held and shard[x] != at:
                    yield from judged(held)
                    held = []
                at = shard[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from judged(held)

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int"))
    return dealt.repartition(int(tasks), "shard").sortWithinPartitions("shard", "doc", *ROW, "lo").mapInArrow(lean(run), SPAN)


def split(found: DataFrame, kind: str, window: int, step: int) -> DataFrame:
    """Contexts cut into pieces: runs of windows whose distance from the anchor is the same multiple of `step`.

    A piece's new anchor is the hash of what all such windows have in common, which grows to the whole window as `step`
    falls to one. Equal windows still meet; others part unless they share all but `step` symbols. `c` is the hash of the piece.
    """
    ddl = CONTEXT + ", c long"
    made = arrow_schema(ddl)
    width = np.uint8 if kind == "bytes" else np.uint64

    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("row", "a", "c", "lo", "n", "d", "ctx")}
            names = ("a", "lo", "n", "d", "ctx")
            for i, (a, lo, n, d, ctx) in enumerate(zip(*(batch.column(x).to_pylist() for x in names))):
                symbols = np.frombuffer(ctx, width)
                for b in range((d - n + 1) // step * step, d + 1, step):
                    far, near = min(d, b + step - 1), max(d - n + 1, b)
                    piece = symbols[d - far : d - near + window].tobytes()
                    core = symbols[d - b : d - b - step + 1 + window].tobytes()
                    key = xxhash.xxh64(a.to_bytes(8, "little", signed=True) + b.to_bytes(4, "little"))
                    key.update(core)
                    out["row"].append(i)
                    out["a"].append(key.intdigest())
                    out["c"].append(xxhash.xxh64_intdigest(piece, far * 1024 + near))
                    for name, value in zip(("lo", "n", "d", "ctx"), (lo + d - far, far - near + 1, far, piece)):
                        out[name].append(value)
            row = pa.array(out.pop("row"), pa.int64())
            hashes = {name: np.array(out.pop(name), np.uint64).view(np.int64) for name in ("a", "c")}
            yield zipped(made, **hashes, **out, **{name: batch.column(name).take(row) for name in ("uid", "u2", "doc", "many")})

    return found.mapInArrow(lean(run), ddl)


def refined(hot: DataFrame, kind: str, window: int, most: int, keep_first: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans settled, contexts for shards) of contexts whose anchors have more than `most` of them."""
    spans, calm = [], []
    for step in [x for x in STEPS[kind] if x < window]:
        pieces = stored(split(hot, kind, window, step), "pieces")
        first = F.min(F.struct("doc", *ROW, "lo")).alias("rep")
        groups = stored(pieces.groupBy("a", "c").agg(F.sum("many").alias("all"), F.count(F.lit(1)).alias("members"), first), "piece-classes")
        known = pieces.join(groups.filter("members > 1"), ["a", "c"])
        known = known.filter("not (doc <=> rep.doc and uid = rep.uid and u2 = rep.u2 and lo = rep.lo)") if keep_first else known.filter("many = 1")
        spans.append(known.select(*ROW, F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + window).alias("e")))
        mixed = groups.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        own = groups.join(mixed, "a").select("a", "c", "k", "all", "rep")
        left = pieces.drop("many").join(own, ["a", "c"]).filter("doc <=> rep.doc and uid = rep.uid and u2 = rep.u2 and lo = rep.lo")
        left = stored(left.withColumnRenamed("all", "many").select("k", *arrow_schema(CONTEXT).names), "split-contexts")
        calm.append(left.filter(F.col("k") <= most).drop("k"))
        hot = left.filter(F.col("k") > most).drop("k")
        if hot.isEmpty():
            break
    return spans, calm  # pieces of one window have one context


def repeated_spans(docs: DataFrame, kind: str, window: int, gram: int, kernel: Kernel, keep_first: bool, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): `keyed` documents, and the symbols [s, e) of repeated windows, by row.

    keep_first: a window's first occurrence does not count as repeated. Documents come in order of id, null ids first; those
    of one id, which differ in text, in order of their hashes. Anchors with more than `most_contexts` different contexts are split.
    """
    rows = keyed(docs, id_col, text_col)
    table = stored(anchor_table(rows, kind, window, gram, keep_first), "anchors")
    seen = stored(table.filter("a is null").select(*ROW, F.col("lo").alias("s"), (F.col("lo") + F.col("n")).alias("e")), "seen")
    # stored, so that the join's sides are plain shuffles and a hot anchor's rows can be split over tasks
    common = stored(table.filter("a is not null").groupBy("a").agg(F.sum("many").alias("k")).filter("k > 1").select("a"), "common-anchors")
    again = stored(table.join(common, "a", "left_semi"), "shared-anchors")
    discard(table, common)
    first = F.min(F.struct("doc", *ROW, "lo", "n", "d")).alias("rep")
    classes = stored(again.groupBy("a", "c").agg(F.sum("many").alias("many"), first), "classes")
    settled = (again if keep_first else again.filter("many = 1")).drop("many").join(classes.filter("many > 1"), ["a", "c"])
    if keep_first:
        settled = settled.filter("not (doc <=> rep.doc and uid = rep.uid and u2 = rep.u2 and lo = rep.lo)")
    spans = [seen, settled.select(*ROW, F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + window).alias("e"))]
    mixed = stored(classes.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "mixed-anchors")
    reps = stored(classes.join(mixed, "a").select("a", "many", "k", "rep.*"), "representatives")
    size, hot = reps.agg(F.sum(F.col("n") + window), F.max("k")).first()
    calm = [contexts(rows, reps.filter(F.col("k") <= most_contexts), kind, window)]
    if (hot or 0) > most_contexts:
        known, more = refined(contexts(rows, reps.filter(F.col("k") > most_contexts), kind, window), kind, window, most_contexts, keep_first)
        spans, calm = spans + known, calm + more
    inside = shard_spans(reduce(DataFrame.unionByName, calm), (size or 0) * (1 if kind == "bytes" else 8), kind, window, kernel, keep_first)
    found = stored(reduce(DataFrame.union, [*spans, inside]), "spans")
    discard(again, classes, mixed, reps, seen)
    return rows, found


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, u2, doc, z, spans): every document, compressed, with its spans (null where it has none)."""
    own = spans.groupBy(*ROW).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return packed(rows).join(own, ROW, "left").select(*ROW, "doc", "z", "spans")


def merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal [s, e) of one document's spans (touching ones joined), in order."""
    flat = spans.flatten()
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z
    s, e = (x.to_numpy().astype(np.int64) for x in flat.flatten())
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], np.append(e[:-1][new[1:]], e[-1])
