"""Katz backoff: Good-Turing discounted bigrams that back off to unigrams, over whole corpora.

Words are 64-bit hashes, and all words and all pairs are counted apart; what a training text never holds is one event, the
unseen word. Texts come in chunks of a few megabytes, stored as indexes into the chunk's own sorted words. A chunk asks the tables
twice, by partition: first how often each of its words was learned, then how often each of its pairs, and what its histories
have seen. A partition gets each key at most once from a chunk, with the chunk's own training counts, so the
tables are counted and answered in one go; with the answers the chunk evaluates the recursion for each token.

Pairs are dealt by history, so a history's weights are known where its pairs are. A history with more than a share of all
tokens is dealt in slices, and only such (`HOT` at most) have their sums gathered and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, mix64, row_chunks, stored, utf8_view, word_hashes, words_of, zipped
from .simhash import _LOWER

CHUNK = 8 << 20
PART_TOKENS = 4_000_000
HOT = 1 << 20
#: Chunks that a task works through, about.
TASK_CHUNKS = 4
END_WORD = np.uint64(0xE0D0)  # the hash that stands for the end of a text
BEGIN = np.uint64(0xBE61)  # the history of a text's first token
LARGE = 5  # counts above it are not discounted
CUT = np.uint64(16)  # successors travel as the upper 48 bits of their hash, beside the history's 64


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token: words with A-Z lowered, and an end after each row's."""
    data = _LOWER[data]
    starts, ends, rows = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    stop = np.searchsorted(rows, np.arange(n), "right")
    h, rows = np.insert(h, stop, END_WORD), np.insert(rows, stop, np.arange(n))
    return h, rows


def good_turing(n: np.ndarray, large: int = LARGE) -> np.ndarray:
    """Katz's discount ratios d[0..large] from n[r], the number of events seen r times (r up to large + 1).

    Counts of counts that give no ratio in (0, 1] (too little data) leave that count as it is.
    """
    d = np.ones(large + 1)
    if n[1] > 0:
        rest = (large + 1) * n[large + 1] / n[1]
        for r in range(1, large + 1):
            if n[r] > 0 and rest < 1:
                ratio = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
                if 0 < ratio <= 1:
                    d[r] = ratio
    return d


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LARGE, discounts[np.minimum(counts, LARGE)], 1.0)


@dataclass
class Unigrams:
    """Good-Turing probabilities from a word's training count; all words never seen share one probability."""

    total: int
    types: int
    discounts: np.ndarray
    scale: float
    unseen: float

    @staticmethod
    def build(total: int, types: int, n: np.ndarray) -> Unigrams:
        """n[r]: words seen r times (r up to LARGE + 1)."""
        d, r = good_turing(n), np.arange(LARGE + 1)
        kept = float((d * r * n[: LARGE + 1]).sum() + total - (r * n[: LARGE + 1]).sum())
        other = max(total - kept, total / (total + 1.0))
        return Unigrams(total, types, d, (total - other) / kept / total if total else 0.0, other / total if total else 1.0)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.discounts) * self.scale, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))


def weights(n: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, alpha) of histories: P(w|h) = scale * d[c] * c if the pair was seen, else alpha * P(w).

    n: how often the history was seen; kept: the sum of its pairs' discounted counts; seen: the unigram mass of their words.
    Both parts add up to one: scale * kept + alpha * (1 - seen) = 1.
    """
    left = np.where(kept > 0, np.maximum(1 - kept / np.maximum(n, 1), 1 / (n + 1.0)), 1.0)
    rest = 1 - seen
    left = np.where(rest > 1e-12, left, 0.0)  # no word is left to back off to
    return np.where(kept > 0, (1 - left) / np.where(kept > 0, kept, 1), 0.0), left / np.where(rest > 1e-12, rest, 1)


def squeezed(*columns: np.ndarray) -> bytes:
    """Unsigned integers, byte planes first, compressed; ascending runs are best given as differences."""
    parts = [np.array([len(c) for c in columns], np.uint64).tobytes()]
    parts += [c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def grown(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes, at, out = raw[: 8 * columns].view(np.uint64).tolist(), 8 * columns, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(np.uint64).ravel())
        at += 8 * n
    return out


def dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): keys by partition, in their own order within one; partition p is order[cuts[p]:cuts[p + 1]]."""
    part = (mix64(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


class Chunk:
    """Some texts' tokens as places among the chunk's own words, which are sorted by hash."""

    def __init__(self, blob: bytes, held: np.ndarray):
        steps, ranks, often, size = (c.view(np.int64) for c in grown(blob, 4))
        self.words = np.cumsum(steps.view(np.uint64), dtype=np.uint64)
        self.index = np.argsort(-often, kind="stable")[ranks]
        self.row = np.repeat(np.arange(len(size)), size)
        self.learn = ~held

    @staticmethod
    def pack(h: np.ndarray, row: np.ndarray, n: int) -> bytes:
        """Tokens as ranks by frequency, whose upper bytes compress well; the ranks follow from the counts."""
        words, index, often = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
        return squeezed(np.diff(words, prepend=np.uint64(0)), rank[index], often, np.bincount(row, minlength=n))

    def learned(self, of: np.ndarray, n: int) -> np.ndarray:
        """How many of the training texts' tokens have each of n values."""
        return np.bincount(of, self.learn[self.row].astype(float), n).astype(np.int64)

    def questions(self, parts: int) -> Iterator[tuple[int, bytes]]:
        order, cuts = dealt(self.words, parts)
        often = self.learned(self.index, len(self.words))
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            yield int(p), squeezed(np.diff(self.words[own], prepend=np.uint64(0)), often[own])

    def take_counts(self, blobs: list[bytes], parts: int, whole: int) -> None:
        """The answers to `questions`, by partition; then pairs are known, and how they are dealt."""
        counts = np.empty(len(self.words), np.int64)
        counts[dealt(self.words, parts)[0]] = np.concatenate([grown(b, 1)[0] for b in blobs]).astype(np.int64)
        self.counts = counts
        # the last history is the beginning, which is as frequent as the end
        self.hashes = np.append(self.words, BEGIN)
        self.seen_often = np.append(counts, counts[np.searchsorted(self.words, END_WORD)])
        before = np.append(0, self.index[:-1])
        before[np.flatnonzero(np.diff(self.row, prepend=-1))] = len(self.words)
        pair, self.of = np.unique(before * len(self.hashes) + self.index, return_inverse=True)
        self.h, self.w = np.divmod(pair, len(self.hashes))
        self.hot = self.seen_often > whole
        h = self.hashes[self.h]
        self.order, self.cuts = dealt(np.where(self.hot[self.h], h ^ mix64(self.words[self.w]), h), parts)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, its pairs, where among them each history begins)."""
        for p in np.flatnonzero(np.diff(self.cuts)):
            own = self.order[self.cuts[p] : self.cuts[p + 1]]
            yield int(p), own, np.flatnonzero(np.diff(self.h[own], prepend=-1))

    def pair_questions(self) -> Iterator[tuple[int, bytes]]:
        often = self.learned(self.of, len(self.h))
        for p, own, lead in self.parts():
            h = self.h[own[lead]]
            w, place = np.unique(self.w[own], return_inverse=True)
            steps = self.hashes[h] - np.append(np.uint64(0), self.hashes[h[:-1]])
            yield p, squeezed(steps, self.hot[h], np.diff(np.append(lead, len(own))), np.diff(self.words[w] >> CUT, prepend=np.uint64(0)), self.counts[w], place, often[own])

    def scores(self, blobs: list[bytes], words: Unigrams, discounts: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base, score) of each text, from the answers to `pair_questions`."""
        c = np.zeros(len(self.h), np.int64)
        kept, seen = np.zeros(len(self.hashes)), np.zeros(len(self.hashes))
        for blob, (_, own, lead) in zip(blobs, self.parts(), strict=True):
            own_c, *few, large, mass = grown(blob, LARGE + 3)
            c[own] = own_c.astype(np.int64)
            h = self.h[own[lead]]
            kept[h] = sum(discounts[r] * r * f for r, f in enumerate(few, 1)) + large
            seen[h] = mass.view(np.float64)
        at = np.flatnonzero(self.hot)
        place = np.searchsorted(hot[0], self.hashes[at])
        kept[at], seen[at] = hot[1][place], hot[2][place]
        scale, alpha = weights(self.seen_often, kept, seen)
        p = words.p(self.counts)
        with np.errstate(divide="ignore"):
            logs = np.log10(np.where(c > 0, scale[self.h] * discounted(c, discounts), alpha[self.h] * p[self.w]))
        n = len(self.learn)
        known = np.bincount(self.row, (self.counts > 0)[self.index], n).astype(np.int64)
        return np.bincount(self.row, minlength=n), known, np.bincount(self.row, words.base(self.counts)[self.index], n), np.bincount(self.row, logs[self.of], n)


def grouped(batches, key: int) -> Iterator[list[dict]]:
    """The rows of each value of a sorted partition's column."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            if held and held[0][batch.schema.names[key]] != row[batch.schema.names[key]]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


ASKED = "part int, chunk long, blob binary"
ANSWERED = "chunk long, part int, blob binary, stats array<long>, h long, sums array<double>"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, whole: int = PART_TOKENS // 16) -> DataFrame:
    """One row per document: its size, known words, base score and the model's log10 probability.

    Learned from the documents whose crc32(id) mod `folds` is not `held`; a null id is learned from. Null texts are
    empty: one token, the end. Repeated rows count and are scored once each; an empty table gives an empty result; other
    columns are not read. Histories seen more often than `whole` (and than a HOT-th of all tokens) are dealt in slices.
    """
    spark = docs.sparkSession
    doc = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.coalesce(fold(doc, folds) == held, F.lit(False)).alias("held"), text.alias("text"))

    ddl = "chunk long, doc array<long>, held array<boolean>, size long, blob binary"
    split = arrow_schema(ddl)

    def chunked(batches):
        many = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8_view(batch.column(2))
            for a, b in row_chunks(offsets, CHUNK):
                h, row = lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = {name: pa.array([batch.column(k).slice(a, b - a).to_pylist()], split.field(name).type) for k, name in enumerate(("doc", "held"))}
                yield zipped(split, chunk=[many], **lists, size=[len(h)], blob=[Chunk.pack(h, row, b - a)])
                many += 1

    chunks = stored(rows.mapInArrow(chunked, ddl), "chunks")
    size, n_chunks = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, tasks = max(least, -(-size // PART_TOKENS)), max(least, -(-n_chunks // TASK_CHUNKS))
    asked, answered = arrow_schema(ASKED), arrow_schema(ANSWERED)
    blank = dict.fromkeys(answered.names, [None])

    def ask(chunk, questions):
        for p, blob in questions:
            yield zipped(asked, part=[p], chunk=[chunk], blob=[blob])

    def table(questions: DataFrame, answer, label: str) -> DataFrame:
        return stored(questions.repartitionById(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(answer, ANSWERED), label)

    def ask_words(batches):
        for batch in batches:
            for chunk, held_out, blob in zip(*(c.to_pylist() for c in batch.columns)):
                yield from ask(chunk, Chunk(blob, np.array(held_out, bool)).questions(parts))

    def count_words(batches):
        for own in grouped(batches, 0):
            steps, often = zip(*(grown(r["blob"].as_py(), 2) for r in own))
            key, back = np.unique(np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps]), return_inverse=True)
            c = np.bincount(back, np.concatenate(often).astype(float)).astype(np.int64)
            at = 0
            for r, s in zip(own, steps):
                yield zipped(answered, **blank | {"chunk": [r["chunk"].as_py()], "part": [r["part"].as_py()], "blob": [squeezed(c[back[at : at + len(s)]])]})
                at += len(s)
            yield zipped(answered, **blank | {"stats": [[int(c.sum()), int((c > 0).sum()), *(int((c == r).sum()) for r in range(1, LARGE + 2))]]})

    def totals(answers: DataFrame, n: int) -> list[int]:
        return [x or 0 for x in answers.agg(*[F.sum(F.col("stats")[k]) for k in range(n)]).first()]

    unigrams = table(chunks.select("chunk", "held", "blob").mapInArrow(ask_words, ASKED), count_words, "unigrams")
    total, types, *n = totals(unigrams, LARGE + 3)
    words = Unigrams.build(total, types, np.array([0, *n], float))
    whole = max(whole, total // HOT)

    def with_answers(*tables: DataFrame) -> DataFrame:
        """The chunks, each followed by what the tables answered, by table and partition."""
        none = F.lit(None)
        all_rows = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), "doc", "held", "blob")
        for k, t in enumerate(tables, 1):
            told = t.filter("chunk is not null").select("chunk", F.lit(k), "part", none.cast("array<long>"), none.cast("array<boolean>"), "blob")
            all_rows = all_rows.unionAll(told)
        return all_rows.repartition(int(tasks), "chunk").sortWithinPartitions("chunk", "kind", "part")

    def opened(batches):
        """(chunk, its row, the answers of the second table) with the first table's taken in."""
        for first, *told in grouped(batches, 0):
            got = Chunk(first["blob"].as_py(), np.array(first["held"].as_py(), bool))
            answers: list[list] = [[], []]
            for r in told:
                answers[r["kind"].as_py() - 1].append(r["blob"].as_py())
            got.take_counts(answers[0], parts, whole)
            yield got, first, answers[1]

    def ask_pairs(batches):
        for got, first, _ in opened(batches):
            yield from ask(first["chunk"].as_py(), got.pair_questions())

    def count_pairs(batches):
        for own in grouped(batches, 0):
            steps, hot, many, word_steps, known, place, often = zip(*(grown(r["blob"].as_py(), 7) for r in own))
            each = [np.cumsum(s, dtype=np.uint64) for s in steps]
            h = np.concatenate([np.repeat(e, m.astype(np.int64)) for e, m in zip(each, many)])
            w = np.concatenate([np.cumsum(s, dtype=np.uint64)[x.view(np.int64)] for s, x in zip(word_steps, place)])
            with np.errstate(over="ignore"):
                key, first, back = np.unique(mix64(h + mix64(w)), return_index=True, return_inverse=True)
            c = np.bincount(back, np.concatenate(often).astype(float)).astype(np.int64)
            word = np.zeros(len(key), np.int64)
            word[back] = np.concatenate([n[x.view(np.int64)] for n, x in zip(known, place)]).astype(np.int64)
            of, by = np.unique(h[first], return_inverse=True)
            few = [np.bincount(by[c == r], minlength=len(of)) for r in range(1, LARGE + 2)]
            large = np.bincount(by, np.where(c > LARGE, c, 0), len(of)).astype(np.int64)
            seen = np.bincount(by, np.where(c > 0, words.p(word), 0.0), len(of))
            at = 0
            for r, e, x, m in zip(own, each, hot, often):
                at_h = np.searchsorted(of, e)
                told = [np.where(x > 0, 0, v[at_h]) for v in (*few[:LARGE], large)]
                blob = squeezed(c[back[at : at + len(m)]], *told, np.where(x > 0, 0.0, seen[at_h]).view(np.uint64))
                yield zipped(answered, **blank | {"chunk": [r["chunk"].as_py()], "part": [r["part"].as_py()], "blob": [blob]})
                at += len(m)
            sliced = np.searchsorted(of, np.unique(np.concatenate([e[x > 0] for e, x in zip(each, hot)])))
            if len(sliced):
                sums = np.array([*few[:LARGE], large, seen], float)[:, sliced].T
                full = {name: pa.nulls(len(sliced), answered.field(name).type) for name in answered.names}
                yield zipped(answered, **full | {"h": of[sliced].view(np.int64), "sums": sums.tolist()})
            yield zipped(answered, **blank | {"stats": [[int(f.sum()) for f in few]]})

    bigrams = table(with_answers(unigrams).mapInArrow(ask_pairs, ASKED), count_pairs, "bigrams")
    d2 = good_turing(np.array([0, *totals(bigrams, LARGE + 1)], float))
    kept = sum(F.lit(float(d2[r]) * r) * F.col("sums")[r - 1] for r in range(1, LARGE + 1)) + F.col("sums")[LARGE]
    sliced = bigrams.filter("h is not null").groupBy("h").agg(F.sum(kept).alias("kept"), F.sum(F.col("sums")[LARGE + 1]).alias("seen")).toPandas()  # HOT rows at most
    h = sliced["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    hot = spark.sparkContext.broadcast((h[order], sliced["kept"].to_numpy(float)[order], sliced["seen"].to_numpy(float)[order]))
    ddl = "doc long, held boolean, n long, known long, base double, score double"
    scored = arrow_schema(ddl)

    def evaluate(batches):
        for got, first, answers in opened(batches):
            n, known, base, score = got.scores(answers, words, d2, hot.value)
            yield zipped(scored, doc=first["doc"].values, held=first["held"].values, n=n, known=known, base=base, score=score)

    each = with_answers(unigrams, bigrams).mapInArrow(evaluate, ddl)
    return each.select(
        F.col("doc").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
