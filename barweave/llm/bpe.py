"""Byte-level BPE as a streaming transducer, and its inverse.

A tokenizer file (JSON of the public `tokenizers` library, byte-level BPE) gives the tokens and the
merge list. Encoding does not run the merges over a whole text. It uses two facts of BPE:

* a token sequence is the encoding of its bytes exactly if every neighbouring pair of tokens is the
  encoding of that pair's bytes;
* so the encoding of every prefix ends in exactly one token that fits the encoding of what is before.

`Transducer` keeps that last token for each prefix of what is pending. A later token can begin only
in the last `longest` bytes (the longest token), so the tokens that the encodings of all those
prefixes share can no longer change: they are emitted and forgotten. How far behind the end a token
can stay undecided is bounded by the merge list alone (`sufficient_lookahead`), so memory is constant.
`TextDecoder` turns ids back into text byte by byte, keeping at most an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, zipped

# fixed values: the byte-level pre-tokeniser's pattern
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_PIECES = regex.compile(PIECES)
#: No piece holds white space behind something else, so a text may be cut there.
_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
SEGMENT = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, as letter to byte.

    Printable Latin-1 letters stand for themselves, the other bytes, in order, for the letters from
    code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Tokens, merges and added tokens of a tokenizer file."""

    def __init__(self, source: bytes | str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        #: Every ending of a token, with its id if it is a token itself: a backward scan stops where
        #: the bytes are none of them.
        self.endings = {b[k:]: -1 for b in self.ids for k in range(len(b))} | self.ids
        self.known_fits: dict[tuple[int, int], bool] = {}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def sufficient_lookahead(self) -> int:
        """Bytes beyond a token's end after which the merge list cannot change it any more.

        A change runs leftwards through merges of falling priority, each touching at most one more
        token, so it passes no more tokens than there are priorities. That is the bound of the
        literature (rules times longest token); `Transducer` measures stability and emits sooner.
        """
        return len(self.merges) * self.longest

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the definition: the best merge first, leftmost among equals. For short data."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (at a piece's start: -1), by encoding their bytes."""
        if len(self.known_fits) > 1 << 20:
            self.known_fits.clear()
        pair = [a, b] if a >= 0 else [b]
        known = self.known_fits[a, b] = self.merged(b"".join([self.bytes[i] for i in pair])) == pair
        return known

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, text) in order."""
        if self._split is None or not any(t in text for t in self.added):
            yield False, text
            return
        for k, part in enumerate(self._split.split(text)):
            if part:
                yield k % 2 == 1, part


class Transducer:
    """Encodes one piece, given in chunks of any size, in constant memory."""

    def __init__(self, model: Model):
        self.model = model
        self.data = bytearray()  # pending bytes
        self.last = [-1]  # last token of the encoding of each pending prefix
        self.base = -1  # the last token emitted

    def feed(self, chunk: bytes) -> list[int]:
        """Take bytes; return the tokens that became stable."""
        out: list[int] = []
        endings, known, fits = self.model.endings.get, self.model.known_fits.get, self.model.fits
        step = 4 * self.model.longest
        for at in range(0, len(chunk), step):
            first = len(self.data) + 1
            self.data += chunk[at : at + step]
            seen, last, base = bytes(self.data), self.last, self.base
            for n in range(first, len(seen) + 1):
                start = n - 1
                while True:
                    t = endings(seen[start:n])
                    if t is None or start < 0:
                        raise AssertionError("no token fits; the merge list is not proper")
                    if t >= 0:  # exactly one token fits, so the first found is the one
                        before = last[start] if start else base
                        ok = known((before, t))
                        if fits(before, t) if ok is None else ok:
                            last.append(t)
                            break
                    start -= 1
            if len(seen) > 2 * step:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emit what the encodings of all prefixes that a later token may follow have in common."""
        n, sizes = len(self.data), self.model.bytes
        open_ends = set(range(max(0, n + 1 - self.model.longest), n + 1))
        while len(open_ends) > 1:
            end = max(open_ends)
            open_ends.discard(end)
            open_ends.add(end - len(sizes[self.last[end]]))
        cut = open_ends.pop()
        if cut == 0:
            return []
        out = self._path(cut)
        self.base = out[-1]
        del self.data[:cut]
        self.last = [-1, *self.last[cut + 1 :]]
        return out

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end -= len(self.model.bytes[self.last[end]])
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._path(len(self.data))
        self.data, self.last, self.base = bytearray(), [-1], -1
        return out


class TextDecoder:
    """Ids to text, one at a time; keeps at most the bytes of an unfinished character."""

    def __init__(self, model: Model):
        self.model, self.machine = model, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join([self.model.bytes[i] for i in ids]))

    def feed_bytes(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class PieceMemo(dict):
    """Piece to (ids as text, bytes by decoding those ids); bounded, the older half goes first."""

    def __init__(self, model: Model, most: int = 1 << 18):
        super().__init__()
        self.model, self.most, self.older = model, most, {}

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            t = Transducer(self.model)
            ids = t.feed(piece.encode()) + t.finish()
            found = ",".join(map(str, ids)), b"".join([self.model.bytes[i] for i in ids])
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """Cut a text where no piece is cut."""
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class Codec:
    """Encode and decode whole texts, remembering frequent pieces."""

    def __init__(self, source: bytes | str):
        self.model = Model(source)
        self.memo = PieceMemo(self.model)

    def encoded(self, text: str) -> Iterator[tuple[str, bytes]]:
        """(ids as text, their bytes) for each stretch of the text."""
        memo = self.memo
        for added, part in self.model.parts(text):
            if added:
                yield str(self.model.added[part]), self.model.bytes[self.model.added[part]]
                continue
            for segment in segments(part):
                got = [memo[p] for p in _PIECES.findall(segment)]
                yield ",".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encoded(text) for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        d = TextDecoder(self.model)
        return d.feed(ids) + d.finish()


_CODECS: dict[str, Codec] = {}


def codec(digest: str, source: bytes) -> Codec:
    """One codec for each tokenizer file and worker process."""
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(source)
    return _CODECS[digest]


def _shipped(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        source = f.read()  # a vocabulary file; its size does not grow with the data
    return hashlib.sha256(source).hexdigest(), docs.sparkSession.sparkContext.broadcast(source)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of each whole text. A null text gives null, an empty one an empty list."""
    digest, source = _shipped(docs, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(digest, source.value)
        return texts.map(lambda t: None if t is None else own.encode(t))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text of each list of ids. Null gives null; an id that the file lacks is an error."""
    digest, source = _shipped(df, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = codec(digest, source.value)
        return ids.map(lambda x: None if x is None else own.decode(x))

    return df.withColumn(text_col, text(F.col(ids_col)))


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and give a digest of both.

    Null counts as empty: no tokens and the digests of the empty string. Texts stream through in
    stretches of 64 Ki characters, so a long one needs no more memory than itself. Repeated rows
    repeat; an empty table gives an empty one; other columns are not read. No shuffle.
    """
    digest, source = _shipped(docs, path)
    made = arrow_schema(DIGEST_SCHEMA)

    def run(batches):
        own = codec(digest, source.value)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                h, g, n = hashlib.sha256(), hashlib.sha256(), 0
                machine = TextDecoder(own.model)
                for ids, raw in own.encoded(text.as_py() or ""):
                    h.update(("," + ids if n else ids).encode())
                    n += ids.count(",") + 1
                    g.update(machine.feed_bytes(raw).encode())
                g.update(machine.finish().encode())
                counts.append(n)
                ids_hex.append(h.hexdigest())
                text_hex.append(g.hexdigest())
            yield zipped(made, doc_id=batch.column(0), n_tokens=counts, ids_sha256=ids_hex, decoded_sha256=text_hex)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, DIGEST_SCHEMA)
