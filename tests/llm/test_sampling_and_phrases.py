"""Importance resampling and phrases, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridmail.llm import importance, phrases

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df, names=("id", "block", "shard", "part", "kind", "sums", "x.y", "score", "rank", "n", "word", "lang_")):
    return df.withColumns({k: F.lit(1) for k in names})


# -- importance resampling -------------------------------------------------------------------------------------------


def brute_resample(docs, target, buckets=10_000, least=20, percent=25):
    def counts(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])

    own, other = [counts(t) for _, t in docs], [counts(t)[1] for t in target]
    s, t = sum((c for _, c in own), Counter()), sum(other, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (words, c) in zip(docs, own, strict=True):
        n = sum(c.values())
        total = sum(k * math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b, k in c.items())
        weight = total // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted(range(len(out)), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    fit = [k for k in order if out[k][4] >= least]
    ranks = {k: r + 1 for r, k in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*x[:4], ranks.get(k)) for k, x in enumerate(out))


def some_texts(n, seed):
    r = np.random.RandomState(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["ÉTÉ", "été", "ß", "a1b2", "x" * 63, "y" * 64, "z" * 65, "Ü" * 40, "日本語", "0"]
    marks = [" ", ". ", "-", "\n", "_", "\x00", "  "]
    return ["".join(vocabulary[int(len(vocabulary) * r.rand() ** 2)] + marks[r.randint(len(marks))] for _ in range(r.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_resampling(spark, monkeypatch, small):
    if small:  # many blocks, and shards of several parts
        monkeypatch.setattr(importance, "BLOCK", 3000)
        monkeypatch.setattr(importance, "PART", 500)
    docs = [(i * 3 % 101, t) for i, t in enumerate(some_texts(90, 1))] + [(200, None), (201, ""), (202, "A b " * 30_000), (202, "A b " * 30_000), (None, "q r " * 15), (203, "." * 50), (204, "one")]
    target = [*some_texts(12, 2), None, "", "w1 w2 " * 50]
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(5))
    bench = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), ("doc_id", "block", "s", "t"))
    got = Counter(tuple(r) for r in importance.resample(df, bench).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == brute_resample(docs, target)


def test_resampling_edges(spark):
    docs = [(1, "a b c " * 10), (2, "d e f " * 10), (3, None), (4, "a b c " * 10)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(tuple(r) for r in importance.resample(spark.createDataFrame(docs, DOCS), none).select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_resample(docs, [])
    assert importance.resample(spark.createDataFrame([], DOCS), none).count() == 0
    same = [(7, "k l m n " * 8)] * 30  # all tie: each row is drawn or not, and ranks stay distinct
    ranks = [r["rank"] for r in importance.resample(spark.createDataFrame(same, DOCS), none).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 8)) and len(ranks) == 30
    with pytest.raises(TypeError, match="integers"):
        importance.resample(spark.createDataFrame([("1", "a")], "doc_id string, text string"), none)


def test_crcs_of_pairs():
    texts = [t.encode() for t in some_texts(20, 3)]
    text, bucket, words = importance.features(texts, 1 << 31)
    for i, t in enumerate(texts):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
        wanted = Counter(zlib.crc32(f) % (1 << 31) for f in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))])
        assert words[i] == len(w) and Counter(bucket[text == i].tolist()) == wanted


# -- phrases ---------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least=10, top=2000, covered=50):
    f, n = {1: Counter(), 2: Counter(), 3: Counter()}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in f:
                f[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {}
    for k in (2, 3):
        for (lang, *w), a in f[k].items():
            if a < least or k == 2 and any(100 * b >= covered * a for (l3, *x), b in f[3].items() if b >= least and l3 == lang and (x[:2] == w or x[1:] == w)):
                continue
            cuts = []
            for j in range(1, k):
                left, right = f[j][lang, *w[:j]], f[k - j][lang, *w[j:]]
                cuts.append((1_000_000 * a * a // (left * right), j, left, right))
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def phrase_texts(n, seed):
    r = np.random.RandomState(seed)
    vocabulary = ["new", "York", "city", "hall", "of", "the", "Été", "ß", "日本", "a-b", "(x)", "\x01", "New"]
    marks = [" "] * 9 + ["\t", ". ", ",", "\n", "!?", "\r\n", "  "]
    return ["".join(vocabulary[int(len(vocabulary) * r.rand() ** 2)] + marks[r.randint(len(marks))] for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    if small:  # many blocks and ranges, so that first words are cut by the second
        monkeypatch.setattr(phrases, "BLOCK", 2000)
        monkeypatch.setattr(phrases, "RANGE", 64)
    langs = ["en", "en", "en", "de", None, "und", ""]
    rows = [(langs[i % 7], t) for i, t in enumerate(phrase_texts(300, 5))] + [("en", None), (None, ""), ("fr", "rare words only"), ("de", "ein langer text " * 20_000), ("en", "x" * 100_000)] + [("en", "one two three four. ")] * 40
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(6), ("block", "word", "n", "a", "l", "r", "score", "w1", "x.y"))
    got = [tuple(r) for r in phrases.mine(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows)
    few = {tuple(r) for r in phrases.mine(df, top=3, least=15, covered=80).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert few == brute_phrases(rows, 15, 3, 80)


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", None), (None, ".,;"), ("en", "a b c")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("words", [3, 2**21 - 1, 2**21, 2**32 - 1, 2**32, 2**40])
def test_keys(words):
    r = np.random.RandomState(1)
    a, b, c = (r.randint(0, words, 500, dtype=np.int64) + k for k in (1, 1, 0))
    keys = phrases.pack(a, b, c, words)
    assert all((x == y).all() for x, y in zip(phrases.unpack(keys, words), (a, b, c), strict=True))
    order = phrases.radix_order(keys)
    assert [(a[i], b[i], c[i]) for i in order] == sorted(zip(a, b, c, strict=True))
    distinct, counts = phrases.counted(np.concatenate((keys, keys[:, :100]), axis=1))
    assert counts.sum() == 600 and (phrases._columns(b"".join(map(phrases._column, distinct))) == distinct).all()


def test_scores_are_exact(spark):
    rows = [(10**15, 10**15, 10**15), (999_999_999_999_999, 10**15, 10**15), (3_000_000_001, 3_000_000_007, 10**14), (10, 11, 13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = {tuple(r)[:3]: r["s"] for r in df.withColumn("s", phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()}
    assert got == {(a, left, right): 1_000_000 * a * a // (left * right) for a, left, right in rows}


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(phrases, "hash_stretches", lambda data, start, size: np.zeros(len(start), dtype=np.uint64))
    data = b"ab cd ab abc cd ab"
    start, size = np.array([0, 3, 6, 9, 13, 16]), np.array([2, 2, 2, 3, 2, 2])
    kind, first = phrases.numbered(data, start, size, np.array([0, 0, 0, 0, 1, 0]))
    named = [(int(k), data[start[first[k]] :][: size[first[k]]]) for k in kind]
    assert [w for _, w in named] == [b"ab", b"cd", b"ab", b"abc", b"cd", b"ab"] and len(set(named)) == 4
