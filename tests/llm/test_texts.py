"""Ogg, BPE, windows (suffix arrays and Lempel-Ziv), SimHash and Katz against brute force; empty tables give empty results."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from barweave.llm import anchors, bpe, katz, ogg, packing, rlz, simhash, suffix
from barweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def bag(rows):
    return Counter(map(repr, rows))


# -- Ogg ------------------------------------------------------------------------------------------


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_media(docs, texts, none):
    got = ogg.document_media(docs, keep_media=True).collect()
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i, len(raw), len(padded), sha(padded), zlib.crc32(padded[-16:])))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    by = {}
    for r in got:
        media = bytes(r["media"])
        assert (len(media), sha(media)) == (r["media_bytes"], r["media_sha256"])
        back, streams = ogg.load_samples(media)
        assert sha(back) == r["payload_sha256"] and r["feature"].startswith("streams=2;")
        assert by.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert ogg.document_media(none).collect() == []
    table = docs.sparkSession.createDataFrame([(1, bytes(got[0]["media"])), (2, b"OggS junk"), (3, None), (4, b"")], "k long, m binary")
    rows = ogg.ogg_features(table, "m", ["k"]).collect()
    assert [r["k"] for r in rows] == [1, 1, 2] and rows[2]["error"] and rows[0]["error"] is None


def test_ogg_container():
    rnd = np.random.default_rng(1)
    assert ogg.checksum(b"OggS" + bytes(range(200))) == slow_crc(b"OggS" + bytes(range(200)))
    packets = {7: [(rnd.bytes(n), 10 * k) for k, n in enumerate((5, 255, 0, 510, 70000, 254, 65025, 3))], 9: [(b"h", 0)], 8: [(b"x", 0), (b"", 5)]}
    data = ogg.write_container(packets)
    found = ogg.read_container(data)
    assert {s: f.packets for s, f in found.items()} == {s: [p for p, _ in ps] for s, ps in packets.items()}
    assert found[7].granules[-1] == 70 and found[7].times(10, lambda p: 10)[-1] == 7.0
    for at in (0, 5, 30, 100, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_container(bytes(bad))
    for cut in (1, 20, 27, len(data) - 3):
        with pytest.raises(ogg.OggError):
            ogg.read_container(data[:cut])
    pages = [m.start() for m in re.finditer(b"OggS", data)]
    with pytest.raises(ogg.OggError):  # a page is missing
        ogg.read_container(data[: pages[3]] + data[pages[4] :])


# -- BPE -------------------------------------------------------------------------------------------


def test_bpe_query(docs, texts, none):
    t = Tokenizer.from_file(BPE)
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert bag(tuple(r) for r in bpe.token_digests(docs, BPE).collect()) == bag(want)
    assert bpe.token_digests(none, BPE).collect() == []
    both = bpe.decode(bpe.encode(docs.select("text"), BPE), BPE, "ids", "again")
    assert all(r["text"] == r["again"] for r in both.collect())


def test_transducer():
    c, t = bpe.Codec(open(BPE, "rb").read()), Tokenizer.from_file(BPE)
    rng = np.random.default_rng(3)
    for text in ("a" * 5000, "=" * 3000 + "-" * 700, "".join(rng.choice(list("abth e"), 4000)), "ééé" * 900, " " * 2500):
        want = t.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == want
    piece = "abcdefghabab" * 400
    want = t.encode(piece, add_special_tokens=False).ids
    for step in (1, 7, 4096):
        m, got, most = bpe.Transducer(c.model), [], 0
        for a in range(0, len(piece), step):
            got += m.feed(piece[a : a + step].encode())
            most = max(most, len(m.data))
        assert got + m.finish() == want
        assert most <= 8 * c.model.longest + 4 * c.model.longest + 1  # constant memory
    assert c.model.sufficient_lookahead() == 50000 * c.model.longest
    d = bpe.TextDecoder(c.model)
    assert "".join(d.feed([i]) for i in c.encode("日本 😀")) + d.finish() == "日本 😀"


# -- repeated windows ---------------------------------------------------------------------------------


def byte_dedup(texts, w):
    raws = [(t or "").encode() for _, t in texts]
    seen = Counter(r[k : k + w] for r in raws for k in range(len(r) - w + 1))
    out = []
    for (i, _), r in zip(texts, raws):
        gone = bytearray(len(r))
        for k in range(len(r) - w + 1):
            if seen[r[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


@pytest.mark.parametrize("w,hot", [(200, 4096), (40, 4096), (200, 1), (40, 3)])
def test_suffix(docs, texts, none, w, hot):
    got = suffix.deduplicate(docs, window=w, keep_text=True, most_contexts=hot).collect()
    assert bag(tuple(r)[:5] for r in got) == bag(byte_dedup(texts, w))
    for r in got:
        if r["n_removed"] == 0:
            assert sha(r["kept"].encode()) == r["kept_sha256"]
    assert suffix.deduplicate(none).collect() == []


def test_suffix_family_is_order_free():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 3, 60).astype(np.uint8)
    parts = [np.concatenate([rng.integers(0, 3, 30).astype(np.uint8), block[a : a + 40]]) for a in rng.integers(0, 20, 40)]
    w = 25
    seen = Counter(p[k : k + w].tobytes() for p in parts for k in range(len(p) - w + 1))
    want = [[seen[p[k : k + w].tobytes()] > 1 for k in range(len(p) - w + 1)] for p in parts]
    for step in (1, 3, 40):
        family = suffix.SuffixFamily(w)
        for a in range(0, len(parts), step):
            family.add(parts[a : a + step], list(range(a, min(a + step, len(parts)))))
        got = dict(family.repeated())
        assert [got[i].tolist() for i in range(len(parts))] == want
        sizes = [r for r, _, _ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)


def word_dedup(texts, w):
    order = sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for i, t in order:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            key = tuple(words[k : k + w])
            if key in seen:
                gone[k : k + w] = [True] * w
            seen.add(key)
        out[i, t] = (i, len(words), sum(gone), sha(" ".join(x for x, g in zip(words, gone) if not g).encode()))
    return [out[x] for x in texts]


@pytest.mark.parametrize("w,hot", [(20, 4096), (5, 4096), (5, 2), (20, 1)])
def test_rlz(docs, texts, none, w, hot):
    assert bag(tuple(r) for r in rlz.deduplicate(docs, window=w, most_contexts=hot).collect()) == bag(word_dedup(texts, w))
    assert rlz.deduplicate(none).collect() == []


def overlapping(rows_of_one):
    """Rows that repeat, or share an id, whose passages meet those of other rows at anchors of mixed contexts."""
    a, b, c = ([f"w{k * k % 91}{name}" for k in range(n)] for name, n in (("a", 100), ("b", 60), ("c", 50)))
    doc = [" ".join(a), " ".join(b[:30] + a[20:60] + b[30:]), " ".join(a[10:70] + c), " ".join(c[:20] + a[40:] + b[10:40])]
    return [(1, doc[0])] * rows_of_one + [(2, doc[1]), (3, doc[2])] + [(3, doc[2])] * (rows_of_one - 1) + [(4, doc[3]), (None, doc[1])]


@pytest.mark.parametrize("most", [4096, 1])
def test_repeated_rows(spark, most):
    for n in (1, 2, 5):
        rows = overlapping(n)
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = rlz.deduplicate(table, most_contexts=most).collect()
        assert bag(tuple(r) for r in got) == bag(word_dedup(rows, 20))
        assert any(r["n_removed"] for r in got) and not any(r["n_removed"] for r in got if r["doc_id"] is None)
        got = suffix.deduplicate(table, window=60, most_contexts=most).collect()
        assert bag(tuple(r) for r in got) == bag(byte_dedup(rows, 60))


def test_texts_of_one_id(spark):
    """They are documents of their own, in the order of their hashes; a window at an equal place is removed from the later one only."""
    texts = [r for _, r in overlapping(1)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[0] + " tail"), (2, texts[3])]
    uid = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(struct.pack("<q", 1), 42))))[0]
    want, seen = Counter(), set()
    for i, t in sorted(rows, key=lambda x: (x[0], uid(x[1]))):
        words = WORD.findall(t)
        gone = set()
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want[i, len(words), len(gone)] += 1
    for most in (4096, 1):
        got = rlz.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), most_contexts=most)
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == want


def test_sql_of_rlz(spark):
    import duckdb

    from barweave.llm.queries import ORACLE_SQL

    rows = [*overlapping(3), (7, None), (8, "")]
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = rlz.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag(map(tuple, got)) == bag(base.execute(ORACLE_SQL["op9_rlz"]).fetchall())


def test_family_of_a_shard(monkeypatch):
    """A shard's contexts come in several batches, whose levels merge; the result is that of all windows."""
    rng = np.random.default_rng(9)
    block = rng.integers(0, 4, 400).astype(np.uint8)
    w, made = 40, []
    parts = [np.concatenate([rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint8), block[a : a + 60], rng.integers(0, 2, rng.integers(0, 25)).astype(np.uint8)]) for a in rng.integers(0, 340, 300)]
    ctx, at, key = [], [], []
    for p in parts:
        a, _, _, lo, hi, place = anchors.runs(p, np.array([0, len(p)]), w, 8)
        ctx += [p[x : y + w] for x, y in zip(lo, hi)]
        at += (place - lo).tolist()
        key += a.view(np.int64).tolist()

    class Watched(suffix.SuffixFamily):
        def __init__(self, window):
            super().__init__(window)
            made.append(self)

    monkeypatch.setattr(suffix, "SuffixFamily", Watched)
    monkeypatch.setattr(suffix, "BATCH", 16)
    got = suffix.scan(ctx, np.array(key), np.array(at), w)
    seen = Counter(c[k : k + w].tobytes() for c in ctx for k in range(len(c) - w + 1))
    assert got.tolist() == [seen[c[k : k + w].tobytes()] > 1 for c in ctx for k in range(len(c) - w + 1)]
    assert 0 < got.sum() < len(got) and made[0].merges > 10
    for _, level, n in made[0].levels:  # each array is sorted and holds every context of its batches
        for part in (level.right, level.left):
            assert len(part.of) == n and (suffix.strings(part.rows)[1:] >= suffix.strings(part.rows)[:-1]).all()
    monkeypatch.setattr(rlz, "BLOCK", 16)
    words = [np.frombuffer(c, np.uint8).astype(np.uint64) for c in ctx]
    first: set = set()
    want = []
    for c in ctx:
        for k in range(len(c) - w + 1):
            want.append(c[k : k + w].tobytes() in first)
            first.add(c[k : k + w].tobytes())
    assert rlz.parse(words, np.array(key), np.array(at), w).tolist() == want


# -- SimHash -------------------------------------------------------------------------------------------


def simhash_of(t, n=4):
    w = WORD.findall(lower(t))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, texts, none):
    named = [(i, t) for i, t in texts if i is not None]
    fps = [simhash_of(t) for _, t in named]
    up = {i: i for i, _ in named}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, (i, _) in enumerate(named):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(i), root(named[b][0])
                up[max(x, y)] = min(x, y)
    want = bag((i, f"{f:016x}", root(i)) for (i, _), f in zip(named, fps))
    got = simhash.near_duplicates(docs).collect()
    assert bag(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(texts)
    assert simhash.near_duplicates(none).collect() == []


def test_tiles_and_hot_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for _ in range(500):
        f = int(rng.choice(base))
        for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
            f ^= 1 << bit
        fps.add(f)
    fps = np.array(sorted(fps), np.uint64)

    def label(n, pairs):
        forest = simhash.Forest(n)
        for a, b in pairs:
            forest.join(a, b)
        return [forest.root(i) for i in range(n)]

    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = label(len(fps), np.argwhere(close).tolist())
    assert label(len(fps), simhash.tiled_links(fps, None, 4, tile=16)) == want
    half = len(fps) // 2
    cross = label(len(fps), [(a, b) for a, b in np.argwhere(close).tolist() if (a < half) != (b < half)])
    assert label(len(fps), [(a, half + b) for a, b in simhash.tiled_links(fps[:half], fps[half:], 4, tile=8)]) == cross
    reps = spark.createDataFrame([(i, int(f) - (1 << 64) if f >> np.uint64(63) else int(f)) for i, f in enumerate(fps)], "rep long, fp long")
    for rows, agree in ((16384, None), (7, 1), (16384, 2), (7, 3)):  # the second and the last deal groups over slices
        assert label(len(fps), [tuple(r) for r in simhash.links(reps, 4, rows, agree).collect()]) == want
    assert [simhash.agreeing(n, 4, 16384) for n in (1, 6 * 10**7, 10**8, 10**11, 10**14)] == [1, 1, 2, 3, 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 300), (300, 7), (5, 5), (None, 3), (1, 400), (400, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, 300: 7, 1: 1, 2: 1, 400: 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- Katz -----------------------------------------------------------------------------------------------


def test_katz(docs, texts, none):
    tokens = [(i, WORD.findall(lower(t)) + ["</s>"]) for i, t in texts]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    uni = Counter(w for i, ws in tokens if learned(i) for w in ws)
    n, v = sum(uni.values()), len(uni)
    got = katz.score_texts(docs).collect()
    base = [(i, not learned(i), len(ws), sum(w in uni for w in ws), n, round(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in tokens]
    assert bag((*tuple(r)[:5], round(r["base_score"], 5)) for r in got) == bag(base)

    def counts(values):
        return np.array([0] + [sum(c == r for c in values) for r in range(1, 7)], float)

    d1 = katz.good_turing(counts(uni.values()))
    dc = lambda d, c: d[c] * c if c <= 5 else c
    held = sum(dc(d1, c) for c in uni.values())
    other = max(n - held, n / (n + 1))
    p = {w: dc(d1, c) * (n - other) / held / n for w, c in uni.items()} | {"<unk>": other / n}
    pairs: dict = {}
    for i, ws in tokens:
        if learned(i):
            for h, w in zip(["<s>", *ws], ws):
                pairs.setdefault(h, Counter())[w] += 1
    d2 = katz.good_turing(counts([c for q in pairs.values() for c in q.values()]))

    def prob(h, w):
        w = w if w in uni else "<unk>"
        q = pairs.get(h)
        if not q:
            return p[w]
        size, kept = sum(q.values()), sum(dc(d2, c) for c in q.values())
        left = max(1 - kept / size, 1 / (size + 1))
        return (1 - left) * dc(d2, q[w]) / kept if q[w] else left / (1 - sum(p[x] for x in q)) * p[w]

    for h in pairs:
        assert abs(sum(prob(h, w) for w in [*uni, "<unk>"]) - 1) < 1e-9
    want = Counter((i, round(sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *ws], ws)), 5)) for i, ws in tokens)
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in got) == want
    sliced = katz.score_texts(docs, whole=8).collect()  # most histories are dealt in slices
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in sliced) == want
    assert katz.score_texts(none).collect() == []


# -- packing --------------------------------------------------------------------------------------------


def test_packing(docs, texts, none):
    rows = packing.pack(docs, capacity=300, shard_rows=8).collect()
    meta = {(i, t): None for i, t in texts}
    count = Counter(i for i, _ in texts)
    words = {i: len(WORD.findall(t or "")) for i, t in texts}
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_words"]
    assert total == Counter({i: words[i] * c for i, c in count.items()}) and len(meta)
    info = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    bins: dict = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin_id"]), []).append(r)
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 300
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["n_words"]) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        known = [info[r["doc_id"]][0] for r in own if r["doc_id"] in info and r["doc_id"] not in (9, None) and info[r["doc_id"]][0]]
        assert len(known) == len(set(known))
        same = [info[r["doc_id"]][1] or "" for r in own if r["doc_id"] not in (None,)]
        assert len(same) == len(set(same))
    assert packing.pack(none).collect() == []


def test_best_fit():
    rng = np.random.default_rng(2)
    fast, slow = packing.BestFit(50), []
    for _ in range(400):
        size, source, cluster = int(rng.integers(0, 51)), int(rng.integers(0, 6)), int(rng.integers(0, 40))
        open_ = [(b["left"], k) for k, b in enumerate(slow) if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        if open_:
            _, k = min(open_)
        else:
            k = len(slow)
            slow.append({"left": 50, "s": set(), "c": set()})
        at = 50 - slow[k]["left"]
        slow[k]["left"] -= size
        slow[k]["s"].add(source)
        slow[k]["c"].add(cluster)
        assert fast.place(size, source, cluster) == (k, at)
    b = packing.BestFit(10)
    assert [b.place(1, None, None)[0] for _ in range(3)] == [0, 0, 0]


def test_katz_weights():
    """The module's own weights give every history probabilities that sum to one, and every word a probability above zero."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = rng.zipf(1.5, 300).clip(0, 500)
        n = np.bincount(counts, minlength=7)[:7].astype(float)
        words = katz.Unigrams.build(int(counts.sum()), len(counts), n)
        p = words.p(np.append(counts, 0))
        assert abs(p.sum() - 1) < 1e-12 and (p > 0).all()
        c = np.where(rng.random(300) < 0.1, rng.integers(1, 12, 300), 0)
        d = katz.good_turing(np.bincount(c, minlength=7)[:7] * (np.arange(7) > 0).astype(float))
        kept = katz.discounted(c, d)
        scale, alpha = katz.weights(np.array([c.sum()]), np.array([kept.sum()]), np.array([p[:-1][c > 0].sum()]))
        q = np.append(np.where(c > 0, scale * kept, alpha * p[:-1]), alpha * p[-1])
        assert abs(q.sum() - 1) < 1e-12 and (q > 0).all()


def test_katz_equal_chunks(spark, texts):
    """Two partitions of equal rows make equal chunks; each row still gets its own score once."""
    import pandas as pd

    own = [(i, t) for i, t in texts if i is not None][:12]
    one = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    got = katz.score_texts(one.union(one)).toPandas()
    assert len(got) == 2 * len(own)
    spread = pd.DataFrame(got).groupby("doc_id")["score"].agg(["min", "max", "count"])
    assert (spread["count"] == 2).all() and np.allclose(spread["min"], spread["max"]) and (spread["max"] < 0).all()
    alone = katz.score_texts(spark.createDataFrame(own + own, "doc_id long, text string").repartition(5)).toPandas().groupby("doc_id")["score"].first()
    np.testing.assert_allclose(alone, spread["min"], rtol=1e-9)
