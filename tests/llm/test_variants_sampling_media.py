"""Spelling variants, importance resampling and media columns: brute force, awkward rows and empty tables."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import low

from tallyrule.llm import media, resample, spelling

#: Own names and clashing ones.
DOCS = "doc_id long, text string, word string, n string, rank string, `key` string, media string, n_bytes string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "w", "9", None, "k", "m", None) for i, t in rows], schema)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    stems = ["colour", "center", "ÉCOLES", "straße", "aaaaaaa", "banana"] + ["".join(r.choices("abé", k=r.randint(6, 9))) for _ in range(12)]
    texts = []
    for _ in range(60):
        picked = []
        for _ in range(60):
            w = list(r.choice(stems[: r.randint(1, len(stems))]))
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = r.choice(["", "b", "é", "a"])
            picked.append("".join(w))
        texts.append(r.choice([" ", "-", "\n", "1"]).join(picked))
    texts += ["", None, " \n\t", "x" * 3000, ("z" * 900 + " ") * 6, texts[0], texts[1].upper(), "tiny text", "漢字 ÷ × ÿ" * 9]
    out = list(enumerate(texts))
    return [*out, out[3], out[3], (None, texts[4]), (None, None)]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    form, many = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        many[w] = len(others)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, form[w], root(w), n, many[w], words.get(form[w])) for w, n in words.items())


def test_spelling(spark, rows):
    want = variants_by_hand(rows)
    assert Counter(map(tuple, spelling.spelling_variants(table(spark, rows)).collect())) == want
    assert sum(r[1] is not None for r in want) > 5 and max(r[4] for r in want) > 3
    assert spelling.spelling_variants(table(spark, rows).limit(0)).count() == 0


def test_chains_of_forms(spark):
    """Each word is five times as frequent as the one before: the root is at the end of the chain, through shuffled joins too."""
    chain = ["aaaaaabc", "aaaaaab", "aaaaaa", "aaaaaz", "aaaazz"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(6 * 5**k))
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert not any(zlib.crc32(f"5:{w}".encode()) % 199 == 0 for w in chain)
    for held in (None, 0):
        with pytest.MonkeyPatch.context() as m:
            if held is not None:
                m.setattr(spelling, "small", lambda df: df)
            got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(docs).collect()}
        assert got == {w: (chain[k + 1] if k + 1 < len(chain) else None, chain[-1]) for k, w in enumerate(chain)}


def test_words_lose_a_code_point():
    for start in range(2000):
        state = zlib.crc32(f"{start}:".encode())
        h = zlib.crc32(f"{start}:été-élan".encode())
        want = "été-élan" if h % 199 else "été-élan"[: h % 8] + "été-élan"[h % 8 + 1 :]
        assert spelling.lossy("été-élan", state) == want


def sample_by_hand(rows, target):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000))))
    out = []
    for i, x in rows:
        b = buckets(x)
        weight = sum(map(gain, b)) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 25 * len(able) // 100
    ranks = [k + 1 if k < drawn else None for k in range(len(able))]
    return Counter((*r[:4], k) for r, k in zip(able, ranks, strict=True)) + Counter((*r[:4], None) for r in out if not r[4])


def test_importance_sample(spark, rows, monkeypatch):
    target = ["colour center colour", None, "", "banana aaaaaaa école straße"]
    want = sample_by_hand(rows, target)
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    assert Counter(map(tuple, resample.importance_sample(table(spark, rows), bench).collect())) == want
    assert sum(r[4] is not None for r in want) > 10
    monkeypatch.setattr(resample, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(resample, "FREQUENT", 30)
    assert Counter(map(tuple, resample.importance_sample(table(spark, rows).repartition(7), bench).collect())) == want
    monkeypatch.undo()
    assert resample.importance_sample(table(spark, rows).limit(0), bench).count() == 0
    assert Counter(map(tuple, resample.importance_sample(table(spark, rows), bench.limit(0)).collect())) == sample_by_hand(rows, [])


def test_features_equal_plain_ones():
    r = random.Random(1)
    texts = [None, "", "Ab c", "x" * 200 + " " + "y" * 300 + " z", "é Ünï 12", "A-b", "a" * 48 + " " + "b" * 49]
    texts += ["".join(r.choice("aB é1-\n漢𝄞") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for first in (0, 3):
        bucket, text, words = resample.features(pa.array(texts).slice(first))
        mine = defaultdict(list)
        for b, t in zip(bucket, text, strict=True):
            mine[t].append(b)
        for k, t in enumerate(texts[first:]):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            assert words[k] == len(w)
            assert Counter(mine[k]) == Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def area_means(pixels, height, width):
    """Each cell's samples, weighed by how much of them it covers."""
    def cover(size, parts):
        return np.array([[max(0, min((k + 1) * size, (s + 1) * parts) - max(k * size, s * parts)) for s in range(size)] for k in range(parts)])

    down, across = cover(pixels.shape[0], height), cover(pixels.shape[1], width)
    sums = np.einsum("ay,yx...,bx->ab...", down, pixels.astype(np.int64), across)
    area = pixels.shape[0] * pixels.shape[1]
    return (2 * sums + area) // (2 * area)


def test_areas(monkeypatch):
    monkeypatch.setattr(media, "STRIP", 5)
    r = np.random.default_rng(2)
    for shape in [(1, 1), (1, 64), (7, 3), (20, 31), (5, 10), (40, 9, 3), (8, 9), (16, 18)]:
        x = r.integers(0, 256, shape).astype(np.uint8)
        for size in [(8, 9), (1, 1), (3, 20), (32, 32)]:
            assert (media.resize(x, *size) == area_means(x, *size)).all()
    assert (media.resize(r.integers(0, 65536, (9, 9)).astype(np.uint16), 9, 9).dtype == np.uint16)
    bits = media.difference_hash(np.tile(np.arange(9, dtype=np.uint8) * 20, (8, 1)))
    assert bits == "f" * 16 and media.difference_hash(np.zeros((3, 3), np.uint8)) == "0" * 16


def test_forms():
    r = np.random.default_rng(4)
    for h, w in [(1, 1), (3, 5), (4, 8), (2, 9)]:
        g, c = r.integers(0, 256, (h, w)).astype(np.uint8), r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        bits, wide = r.integers(0, 2, (h, w)).astype(np.uint8), r.integers(0, 1000, (h, w)).astype(np.uint16)
        text = lambda x: " ".join(map(str, x.reshape(-1))).encode()
        head = lambda kind, most="": f"P{kind}\n# a note 9 9\n{w} # and one\n{h}\n{most}{chr(10) if most else ''}".encode()
        for data, want in [
            (head(5, 255) + g.tobytes(), g), (head(6, 255) + c.tobytes(), c), (head(2, 255) + text(g), g), (head(3, 255) + text(c) + b" # end", c),
            (head(1) + "".join(map(str, bits.reshape(-1))).encode(), 255 * (1 - bits)), (head(4) + np.packbits(bits, axis=1).tobytes(), 255 * (1 - bits)),
            (head(5, 999) + wide.astype(">u2").tobytes(), wide), (media.to_bmp(g), g), (media.to_bmp(c), c), (media.to_pgm(g.tobytes(), w), g),
        ]:
            got = media.decode(data)
            assert got.shape == want.shape and (got == want).all()
            with pytest.raises(media.Unreadable):
                media.decode(data[: len(data) // 2])
    top_down = bytearray(media.to_bmp(g))
    top_down[22:26] = (-h).to_bytes(4, "little", signed=True)
    assert (media.decode(bytes(top_down)) == g[::-1]).all()
    number = lambda *x: b"".join(n.to_bytes(4, "little") for n in x)
    head = lambda bits, at: b"BM" + number(0, 0, at, 40, 3, 1) + bytes([1, 0, bits, 0]) + number(0, 0, 0, 0, 2, 0)
    palette = bytes([1, 2, 3, 0, 9, 8, 7, 0])
    want = np.array([[[7, 8, 9], [3, 2, 1], [7, 8, 9]]])
    assert (media.decode(head(1, 62) + palette + bytes([0b10100000, 0, 0, 0])) == want).all()
    assert (media.decode(head(4, 62) + palette + bytes([0x10, 0x10, 0, 0])) == want).all()
    assert (media.decode(head(32, 54) + bytes([1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 0])) == [[[3, 2, 1], [6, 5, 4], [9, 8, 7]]]).all()
    for bad in [b"", b"BM", b"P5", b"P7\n1 1\n255\n1", b"P5 0 1 255 x", b"P2 1 1 5 9", b"P2 1 1 5 -", b"P5\n1 1\n70000\nab", b"GIF89a", head(8, 62) + palette + bytes([2, 0, 0, 0]), head(16, 54) + bytes(8)]:
        with pytest.raises(media.Unreadable):
            media.decode(bad)


def test_media(spark, rows, tmp_path):
    images = [(k, d) for k, d in enumerate([None, b"", b"nothing", media.to_pgm(bytes(range(256)), 16), media.to_pgm(bytes(range(256)), 16), media.to_bmp(np.arange(300).astype(np.uint8).reshape(10, 10, 3))])]
    df = spark.createDataFrame([(k, d, "x") for k, d in images], "status int, media binary, dhash string")
    got = {r.status: r["__tr_media"] for r in media.media_tiles(df, size=(8, 12), tile=5).collect()}
    assert got[0].status == "missing" and got[1].status == got[2].status == "unreadable: form"
    assert got[3] == got[4] and (got[3].height, got[3].width, got[3].channels, got[5].channels) == (16, 16, 1, 3)
    for k in (3, 5):
        pixels = media.decode(images[k][1])
        small = media.resize(pixels, 8, 12)
        assert [(t.y, t.x) for t in got[k].tiles] == [(y, x) for y in range(2) for x in range(3)]
        for t in got[k].tiles:
            assert (np.load(io.BytesIO(t.npy)) == small[5 * t.y : 5 * t.y + 5, 5 * t.x : 5 * t.x + 5]).all()
        assert got[k].sha256 == hashlib.sha256(pixels.tobytes()).hexdigest() and got[k].dhash == media.difference_hash(pixels)
    assert media.media_tiles(df.limit(0)).count() == 0

    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        cells = area_means(np.frombuffer(padded, np.uint8).reshape(-1, 64), 8, 9)
        bits = "".join(str(int(b)) for b in (cells[:, :-1] < cells[:, 1:]).reshape(-1))
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}"] += 1
    assert Counter(map(tuple, media.query(spark, str(tmp_path)).collect())) == want
