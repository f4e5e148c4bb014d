"""Language identification with language-bitmask n-gram filters.

The n-grams of each language's labelled texts go into one Bloom filter per language, stored bit-sliced:
row r of one table holds, as a mask, bit r of every language's filter. So one lookup (the AND of a
few rows) returns all languages that hold an n-gram. A text's hits per language are population
counts of those masks; the share expected from false positives is taken off before they decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, give_back, lean, mix64, row_chunks, utf8_view, zipped

UNKNOWN = "und"
GRAM = 4
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Bytes of text at a time; a byte takes some 75 on the way.
CHUNK = 1 << 18


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) for each place of each text.

    An n-gram is four bytes, with A-Z in lower case and every other ASCII byte but letters as a
    space; a text has a space before and behind it. N-grams with more than one space don't count.
    """
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    line = np.full(n + 2 * rows + GRAM, 0x20, np.uint8)
    line[np.arange(n) + 2 * row + 1] = _LETTERS[data]
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    m = len(owner)
    gram = np.zeros(m, np.uint32)
    spaces = np.zeros(m, np.uint8)
    for k in range(GRAM):
        part = line[k : k + m]
        gram = (gram << np.uint32(8)) | part
        spaces += part == 0x20
    inside = np.ones(m, bool)
    ends = np.cumsum(np.diff(offsets) + 2)
    for k in range(1, GRAM):  # n-grams that would run into the next text
        at = ends - k
        inside[at[(at >= 0)]] = False
    good = inside & (spaces <= 1)
    return gram[good], owner[good]


@dataclass
class LanguageFilters:
    """The bit-sliced filters: `table[row, w]` holds bit `row` of 64 languages' filters in word w."""

    langs: list[str]
    prior: list[int]  # order of preference when nothing tells languages apart
    table: np.ndarray
    hashes: int
    false_rate: np.ndarray

    @staticmethod
    def build(members: dict[str, np.ndarray], prior: dict[str, int], rows_log2: int = 19, hashes: int = 2) -> LanguageFilters:
        langs = sorted(members)
        words = max(1, -(-len(langs) // 64))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        table = np.zeros((1 << rows_log2, words), kind)
        for i, lang in enumerate(langs):
            for row in LanguageFilters.rows(members[lang], rows_log2, hashes):
                table[row, i // 64] |= kind(1 << (i % 64))
        fill = np.array([np.count_nonzero((table[:, i // 64] >> kind(i % 64)) & kind(1)) for i in range(len(langs))]) / len(table)
        order = sorted(range(len(langs)), key=lambda i: (-prior.get(langs[i], 0), langs[i]))
        return LanguageFilters(langs, order, table, hashes, fill**hashes)

    @staticmethod
    def rows(grams: np.ndarray, rows_log2: int, hashes: int) -> list[np.ndarray]:
        h = mix64(grams.astype(np.uint64) + np.uint64(0x51ED27))
        mask = np.uint64((1 << rows_log2) - 1)
        return [((h >> np.uint64(32 * k // max(1, hashes - 1) if hashes > 1 else 0)) & mask).astype(np.int64) for k in range(hashes)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages that hold it."""
        found = None
        for row in self.rows(grams, int(np.log2(len(self.table))), self.hashes):
            found = self.table[row] if found is None else found & self.table[row]
        return found

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, share of known n-grams) of each text."""
        rows = len(offsets) - 1
        grams, owner = grams_of(data, offsets)
        total = np.bincount(owner, minlength=rows).astype(float)
        hits = np.zeros((len(self.langs), rows))
        masks = self.masks(grams)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        for i in range(len(self.langs)):
            own = (masks[:, i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
            if len(starts):
                hits[i, owner[starts]] = np.add.reduceat(own, starts, dtype=np.int64)
        rate = self.false_rate[:, None]
        fair = np.maximum(0.0, (hits - rate * total) / np.maximum(1e-9, 1 - rate))
        ranked = fair[self.prior]
        best = np.argmax(ranked, 0)
        with np.errstate(under="ignore"):
            score = 1.0 / np.exp(ranked - ranked.max(0)).sum(0)
        share = ranked.max(0) / np.maximum(total, 1)
        return np.asarray(self.prior)[best], score, np.minimum(share, 1.0)


def fit(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", sample_per_lang: int = 3000, least_share: float = 1e-5) -> LanguageFilters | None:
    """Filters learned from at most about `sample_per_lang` texts of each language among the rows where `learn` holds.

    The sample is by a hash of the id. A language's filter holds the n-grams that make up at least
    `least_share` of its n-grams, so at most 1/least_share of them reach the driver. None if there
    is nothing to learn from.
    """
    named = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    named = named.filter(learn & F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "i"), F.lit(1 << 30)) / float(1 << 30)
    sample = named.filter(draw < share[F.col("l")]).select("l", "t")
    ddl = "l string, g long, n long"
    made = arrow_schema(ddl)

    def count(batches):
        held: dict[str, dict] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                data, offsets = utf8_view(batch.column(1).filter(pa.array(langs == lang)))
                for a, b in row_chunks(offsets, CHUNK):
                    g, n = np.unique(grams_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True)
                    held.setdefault(lang, []).append((g, n))
                    if len(held[lang]) >= 16:
                        held[lang] = [_added(held[lang])]
        for lang, parts in held.items():
            g, n = _added(parts)
            yield zipped(made, l=[lang] * len(g), g=g.astype(np.int64), n=n)

    counts = sample.mapInArrow(lean(count), ddl).groupBy("l", "g").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        counts.unpersist()
        return LanguageFilters.build({k: np.zeros(0, np.uint32) for k in sizes}, sizes)
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n * least_share)])
    kept = counts.filter(F.col("n") >= least[F.col("l")]).select("l", "g").toPandas()
    counts.unpersist()
    members = {lang: kept.loc[kept["l"] == lang, "g"].to_numpy().astype(np.uint32) for lang in sizes}
    return LanguageFilters.build(members, sizes)


def _added(parts):
    g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)


def predict(docs: DataFrame, model: LanguageFilters | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_share.

    `und` with score 0 if the text is null or has no letter, or if there was nothing to learn from.
    A tie goes to the language with most labelled texts, then to the smaller name. Columns of those names in
    the input are replaced. No shuffle; the model (half a million rows of masks) is broadcast.
    """
    names = ("lang_pred", "lang_score", "lang_share")
    docs = docs.drop(*names)
    if model is None or not model.langs:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0), "lang_share": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, share double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for texts in parts:
            data, offsets = utf8_view(pa.array(texts, pa.large_string()))
            out = [own.decide(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets, CHUNK)]
            lang, score, share = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"lang": np.array(own.langs, object)[lang], "score": score, "share": share})
        give_back()

    lettered = F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    found = docs.withColumn("__j", judged(F.col(text_col)))
    return found.withColumns({
        "lang_pred": F.when(lettered, F.col("__j.lang")).otherwise(F.lit(UNKNOWN)),
        "lang_score": F.when(lettered, F.col("__j.score")).otherwise(0.0),
        "lang_share": F.when(lettered, F.col("__j.share")).otherwise(0.0),
    }).drop("__j")


def document_languages(docs: DataFrame) -> DataFrame:
    """Predict every text's language, learning from labelled rows outside the held-out fold.

    Held out: crc32(doc_id) mod 3 is 1 (false for a null id, which is not learned from either).
    """
    part = fold(F.col("doc_id"), 3)
    model = fit(docs, fold(F.col("i"), 3) != 1)
    picked = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(picked, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_share")
