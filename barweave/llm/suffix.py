"""Suffix-array deduplication on bytes, with a logarithmic family of indexes.

A shard's contexts (`repeats.py`) come in batches. `SuffixFamily` gives each batch suffix arrays of its own, scans them merged
with those of every level that it holds for matches of at least a window, and then merges levels of equal size, as in a binary
counter, so a text takes part in logarithmically many merges.

The arrays are sparse: they hold one suffix for each anchor, not for each byte, since equal windows have equal anchors at
equal places. One array sorts the texts from the anchor on, the other the texts before it, backwards. A window that begins d
bytes before its anchor occurs twice if two contexts have d bytes in common before it and window - d from it on,
that is, if they share an interval of both arrays.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_schema, lean, zipped
from .repeats import MOST_CONTEXTS, merged, repeated_spans, with_spans

WINDOW, GRAM = 200, 32
#: Contexts that get suffix arrays together.
BATCH = 1024


def strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as one string each."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def in_common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(1), rows.shape[1], np.argmin(same, 1))
    return out


@dataclass
class SuffixArray:
    """Contexts in the order of their suffixes: the suffixes' first bytes (zeros behind an end) and whose they are."""

    rows: np.ndarray
    of: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, of: np.ndarray) -> SuffixArray:
        order = np.argsort(strings(rows), kind="stable")
        return SuffixArray(rows[order], of[order])

    def merge(self, other: SuffixArray) -> SuffixArray:
        at = np.searchsorted(strings(self.rows), strings(other.rows))
        return SuffixArray(np.insert(self.rows, at, other.rows, 0), np.insert(self.of, at, other.of))

    def only(self, wanted: np.ndarray) -> SuffixArray:
        """The part whose contexts are marked."""
        kept = wanted[self.of]
        return SuffixArray(self.rows[kept], self.of[kept])

    def interval(self, shared: np.ndarray, length: int) -> np.ndarray:
        """For each suffix, in order, where the interval begins whose suffixes agree with it in `length` bytes."""
        return np.maximum.accumulate(np.where(shared < length, np.arange(len(shared)), 0))


@dataclass
class Level:
    """The two arrays of some batches: by the text from the anchor on, and by the text before it."""

    right: SuffixArray
    left: SuffixArray

    def merge(self, other: Level) -> Level:
        return Level(self.right.merge(other.right), self.left.merge(other.left))

    def only(self, wanted: np.ndarray) -> Level:
        return Level(self.right.only(wanted), self.left.only(wanted))


class SuffixFamily:
    """Levels of geometrically growing size; `add` takes a batch of texts."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[tuple[int, Level, int]] = []  # (size class, level, contexts)
        self.seen = np.zeros(0, bool)  # windows known to repeat, in the order in which they were added
        self.owners: list[tuple] = []  # (owner, windows)
        z = np.zeros(0, np.int64)
        self.near, self.far, self.base, self.keys = z, z, z, z  # of each context: its windows' distances, its first one's place in `seen`, its anchor
        self.merges = 0

    def add(self, texts: list[np.ndarray], owners: list, distances: np.ndarray | None = None, anchors: np.ndarray | None = None) -> None:
        """distances, anchors: where each text's anchor is, and its hash; without them, all window starts are anchors of their own."""
        size = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(size) - size
        many = np.maximum(size - self.window + 1, 0)
        self.owners += zip(owners, many.tolist())
        first = len(self.seen) + np.cumsum(many) - many
        self.seen = np.append(self.seen, np.zeros(int(many.sum()), bool))
        if distances is None:
            begin = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(first - first[:1], many)
            first = np.arange(len(self.seen) - len(begin), len(self.seen))
            size, many = np.full(len(begin), self.window), np.ones(len(begin), np.int64)
            distances = anchors = np.zeros(len(begin), np.int64)
        if not len(begin):
            return
        text = np.concatenate(texts)
        at, step = (begin + distances)[:, None], np.arange(self.window)
        on, back = at + step, at - 1 - step
        of = len(self.base) + np.arange(len(begin))
        right = np.where(on < (begin + size)[:, None], text[np.minimum(on, len(text) - 1)], np.uint8(0))
        left = np.where(back >= begin[:, None], text[np.maximum(back, 0)], np.uint8(0))
        level = Level(SuffixArray.build(right, of), SuffixArray.build(left, of))
        for name, more in (("near", distances - many + 1), ("far", distances), ("base", first), ("keys", anchors)):
            setattr(self, name, np.append(getattr(self, name), more))
        self._mark(level)
        for _, other, _ in self.levels:
            self._merge_scan(level, other)
        rank, held = 0, len(begin)
        while self.levels and self.levels[-1][0] == rank:
            _, other, theirs = self.levels.pop()
            level, held, rank = other.merge(level), held + theirs, rank + 1
            self.merges += 1
        self.levels.append((rank, level, held))

    def _merge_scan(self, a: Level, b: Level) -> None:
        """Mark the windows that both levels hold; only anchors of both are read."""
        both = np.intersect1d(self.keys[a.right.of], self.keys[b.right.of])
        wanted = np.isin(self.keys, both)
        if len(both):
            self._mark(a.only(wanted).merge(b.only(wanted)))

    def _mark(self, level: Level) -> None:
        """Mark the windows of a level that share an interval of both arrays with another's."""
        ids = np.sort(level.right.of)
        r, l = np.searchsorted(ids, level.right.of), np.searchsorted(ids, level.left.of)
        shared_r, shared_l = in_common(level.right.rows), in_common(level.left.rows)
        near, far, base = self.near[ids], self.far[ids], self.base[ids]
        of_right, of_left = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for d in range(int(near.min()), int(far.max()) + 1):
            inside = np.flatnonzero((near <= d) & (d <= far))
            if len(inside) < 2:
                continue
            of_right[r] = level.right.interval(shared_r, self.window - d)
            of_left[l] = level.left.interval(shared_l, d)
            key = of_right[inside] * len(ids) + of_left[inside]
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            hit = inside[order[np.append(False, same) | np.append(same, False)]]
            self.seen[base[hit] + far[hit] - d] = True

    def repeated(self):
        """(owner, mask of its windows that occur elsewhere) of every text."""
        at = 0
        for owner, many in self.owners:
            yield owner, self.seen[at : at + many]
            at += many


def scan(contexts: list[np.ndarray], anchors: np.ndarray, distances: np.ndarray, window: int) -> np.ndarray:
    """For each window of the contexts, in order, whether it also starts elsewhere among them."""
    family = SuffixFamily(window)
    for a in range(0, len(contexts), BATCH):
        own = slice(a, a + BATCH)
        family.add(contexts[own], range(a, min(a + BATCH, len(contexts))), distances[own].astype(np.int64), anchors[own])
    return family.seen


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts anywhere else.

    All occurrences go, the first too; matches do not cross documents. Null texts count as empty; a repeated row counts as another
    document; an empty table gives an empty result; other columns are not read. With keep_text the remaining text
    comes along as `kept` (a character of which any byte goes, goes whole), and the row's hashes `uid` and `u2`.
    """
    rows, spans = repeated_spans(docs, "bytes", window, min(GRAM, window), scan, False, id_col, text_col, most_contexts)
    ddl = REMOVED + (", kept string, uid long, u2 int" if keep_text else "")
    made = arrow_schema(ddl)

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = {n: [] for n in made.names}
            for i in range(batch.num_rows):
                text = grow(batch.column(3)[i].as_py())
                s, e = merged(batch.column(4).slice(i, 1))
                kept = b"".join([text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)])])
                row = [batch.column(2)[i].as_py(), len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    lead = [next(k for k in range(a, -1, -1) if k == len(text) or text[k] & 0xC0 != 0x80) for a in s.tolist()]
                    tail = [next((k for k in range(b, min(b + 4, len(text))) if text[k] & 0xC0 != 0x80), len(text)) for b in e.tolist()]
                    row.append(b"".join([text[a:b] for a, b in zip([0, *tail], [*lead, len(text)])]).decode())
                    row += [batch.column(0)[i].as_py(), batch.column(1)[i].as_py()]
                for name, value in zip(out, row):
                    out[name].append(value)
            yield zipped(made, **out)

    return with_spans(rows, spans).mapInArrow(lean(run), ddl).withColumnRenamed("doc_id", id_col)
