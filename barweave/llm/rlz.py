"""Substring deduplication by relative Lempel-Ziv parsing, on words.

A shard's contexts (`repeats.py`) become reference blocks, each a sorted array of the suffixes that begin a window. A
context is parsed against every block of earlier contexts, and against the earlier ones of its own: from its first place on, the
longest match of all blocks is a factor, and factors of at least a window are duplicate spans. A repeat may begin inside one factor
and end beyond it, so after a factor the parse goes on at the first window across the factor's end, not behind it;
with that it finds every repeated window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_schema, lean, words_of, zipped
from .repeats import MOST_CONTEXTS, merged, repeated_spans, with_spans
from .suffix import strings

WINDOW, GRAM = 20, 8
#: Contexts of a reference block.
BLOCK = 1024


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading symbols the rows of a and b share; zeros, behind an end, agree with nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], np.argmin(same, 1))


def ordered(rows: np.ndarray) -> np.ndarray:
    """Rows of symbols as strings that sort like them."""
    return strings(rows.view(np.uint8).reshape(len(rows), -1))


class Block:
    """Suffixes of reference contexts, sorted; rows are big-endian numbers of words, zero behind an end."""

    def __init__(self, rows: np.ndarray, window: int):
        self.texts = rows
        order = np.argsort(ordered(rows), kind="stable")
        self.rows, self.keys = rows[order], ordered(rows[order])
        # the first occurrence of each window, for the parse of the block's own texts
        new = np.append(True, agreement(self.rows[1:], self.rows[:-1]) < window)
        least = np.minimum.reduceat(order, np.flatnonzero(new))
        self.first = np.empty(len(rows), np.int64)
        self.first[order] = least[np.cumsum(new) - 1]

    def longest(self, rows: np.ndarray) -> np.ndarray:
        """The length of each row's longest match, which is next to its place in the order."""
        at, out = np.searchsorted(self.keys, ordered(rows)), np.zeros(len(rows), np.int64)
        for near in (at - 1, at):
            there = np.flatnonzero((near >= 0) & (near < len(self.rows)))
            out[there] = np.maximum(out[there], agreement(rows[there], self.rows[near[there]]))
        return out

    def earlier(self, at: np.ndarray) -> np.ndarray:
        """The length of the match of own texts with the first occurrence of their window, where that is earlier."""
        before = self.first[at] < at
        return np.where(before, agreement(self.texts[at], self.texts[self.first[at]]), 0)


def parse(contexts: list[np.ndarray], anchors: np.ndarray, distances: np.ndarray, window: int) -> np.ndarray:
    """For each window of the contexts, in order, whether it occurs earlier: in an earlier context, or before in its own."""
    size = np.array([len(x) for x in contexts], np.int64)
    many = size - window + 1
    _, number = np.unique(np.concatenate(contexts), return_inverse=True)
    number = np.append((number + 1).astype(">u4"), np.zeros(int(size.max()), ">u4"))
    base, first = np.cumsum(size) - size, np.cumsum(many) - many
    repeats = np.zeros(int(many.sum()), bool)
    blocks: list[Block] = []
    for a in range(0, len(contexts), BLOCK):
        own = slice(a, min(a + BLOCK, len(contexts)))
        n, lead = many[own], first[own] - first[a]
        within = np.arange(int(n.sum())) - np.repeat(lead, n)
        at = (np.repeat(base[own], n) + within)[:, None] + np.arange(int(size[own].max()))
        end = np.repeat(base[own] + size[own], n)[:, None]
        rows = np.where(at < end, number[np.minimum(at, len(number) - 1)], number.dtype.type(0)).astype(">u4")
        block = Block(rows, window)
        cursor, active = np.zeros(len(n), np.int64), np.arange(len(n))
        change = np.zeros(len(rows) + 1, np.int64)
        while len(active):
            here = lead[active] + cursor[active]
            factor = np.maximum.reduce([block.earlier(here), *(x.longest(fitted(rows[here], x.rows.shape[1])) for x in blocks)])
            hit = factor >= window
            np.add.at(change, here[hit], 1)
            np.add.at(change, here[hit] + factor[hit] - window + 1, -1)
            cursor[active] += np.where(hit, factor - window + 1, 1)
            active = active[cursor[active] < n[active]]
        repeats[first[a] : first[a] + len(rows)] = np.cumsum(change[:-1]) > 0
        blocks.append(block)
    return repeats


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """rows cut or filled up with zeros to a block's width; no match with it is longer."""
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))[:, :width])


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that also starts earlier.

    Earlier: in a document with a smaller id, or in the same one before. Null texts have no words; null ids come
    before all others; rows equal in id and text count as one document and each gets its result; texts that
    share an id (or have none) are documents in the order of their hashes. An empty table gives
    an empty result; other columns are not read. With keep_text, the kept words come along, joined by one space.
    """
    rows, spans = repeated_spans(docs, "words", window, min(GRAM, window), parse, True, id_col, text_col, most_contexts)
    ddl = KEPT + (", kept string" if keep_text else "")
    made = arrow_schema(ddl)

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = {n: [] for n in made.names}
            for i in range(batch.num_rows):
                text = grow(batch.column(3)[i].as_py())
                data = np.frombuffer(text, np.uint8)
                starts, ends, _ = words_of(data, np.array([0, len(data)]))
                gone = np.zeros(len(starts) + 1, np.int32)
                s, e = merged(batch.column(4).slice(i, 1))
                gone[s] += 1
                gone[e] -= 1
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                kept = b" ".join([text[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())])
                for name, value in zip(out, (batch.column(2)[i].as_py(), len(starts), len(starts) - len(left), hashlib.sha256(kept).hexdigest(), kept)):
                    out[name].append(value.decode() if name == "kept" else value)
            yield zipped(made, **out)

    return with_spans(rows, spans).mapInArrow(lean(run), ddl).withColumnRenamed("doc_id", id_col)
