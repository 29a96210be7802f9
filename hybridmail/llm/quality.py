"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades are ordered: 0 (toxic), 1 (poor), 2 (good). The proportional-odds model has one weight vector w over hashed
features and ordered thresholds t_0 < t_1: P(grade > k) = sigmoid(w . x - t_k). Expected grade and tail probability
P(grade > 0) ... follow. All grades share the weights; only the thresholds differ.

Features: lower-cased words stripped of punctuation, the words' shapes (capitals, trailing marks, digits, links) and
text-level buckets (shares of repeated words and lines, of capitals, of trailing marks; the power of two of the length).
Counts are damped by log(1 + n) and the word features of a text scaled to one length.

The model is fitted on a bounded sample: at most SAMPLE labelled documents (those of the smallest hash of the id, so the
same ones on each run), in that order as many as have SAMPLE_BYTES together; a text of more than LONGEST bytes takes no part in the
fit, and no place from others. They are featurised on the executors. A grade too rare in it is weighted up, and a feature of
fewer than LEAST_DOCUMENTS sampled documents has no weight. Every document is scored, by its own features alone.

Null and empty texts have only the bias and text-level features and are scored as such. Null ids are scored. Labels
of a document that is labelled twice give its lowest grade. Labels with null quality count as not toxic and poor only if
toxic is null or 0 and quality is 0; with neither they are left out. With fewer than two grades in the sample nothing is
rejected: every document gets the one grade (or the best grade without labels). Repeated rows are scored alike. Other
columns are passed on by `keep` and not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import ship, slices, table, texts_of
from hybridmail.llm.substrings import hash_stretches, word_edges

GRADES = 3
WIDTH = 1 << 20
SAMPLE, SAMPLE_BYTES, LONGEST = 12_000, 256 << 20, 4 << 20
STEPS = 120
#: Bytes of text that are featurised at once.
SLICE = 1 << 20
LEAST_DOCUMENTS = 3
#: A document is rejected if its grade is more likely below the best than the best.
TAIL = 0.5

_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_SHAPES = (re.compile(r"^[A-ZÀ-Þ]{2,}[^\w]*$"), re.compile(r"[#$%&*]{2,}$"), re.compile(r"!{2,}$"), re.compile(r"^[|<>{}]+$"), re.compile(r"^https?:"), re.compile(r"[0-9]"))


class Hashed:
    """What is known of words, in arrays by ascending hash: the bucket of the stripped word, that of its shape (-1: none), and flags (capitals, no letter or digit at its end)."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.own, self.shape, self.flags = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int8)

    @staticmethod
    def of(word: str) -> tuple[int, int, int]:
        plain = word.strip(_STRIP).lower()
        own = zlib.crc32(plain.encode()) % (WIDTH - 1024) + 1024 if plain else -1
        shape = next((8 + i for i, p in enumerate(_SHAPES) if p.search(word)), -1)
        return own, shape, word.isupper() + 2 * (not word[-1:].isalnum())

    def look_up(self, own: np.ndarray, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of ascending hashes that lie in data."""
        if len(self.hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, own)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != own) if len(self.hashes) else np.arange(len(own))
        if len(new):
            found = np.array([self.of(data[a : a + n].decode("utf-8", "replace")) for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)], dtype=np.int64)
            self.hashes, self.own, self.shape, self.flags = (np.insert(x, at[new], y) for x, y in ((self.hashes, own[new]), (self.own, found[:, 0]), (self.shape, found[:, 1]), (self.flags, found[:, 2])))
            at = np.searchsorted(self.hashes, own)
        return self.own[at], self.shape[at], self.flags[at]


def _bucket(share: np.ndarray, first: int) -> np.ndarray:
    return first + np.minimum(15, (share * 16).astype(np.int64))


def featurise(texts: list[bytes], cache: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as CSR: offsets, features and values. All texts at once; a word is looked at once for a batch."""
    n_texts = len(texts)
    data = b"\n".join([*texts, b""])
    start, size = word_edges(data)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=n_texts))))
    bounds = np.searchsorted(start, begins)
    n = np.diff(bounds)
    text = np.repeat(np.arange(n_texts), n)
    words, first, inverse = np.unique(hash_stretches(data, start, size), return_index=True, return_inverse=True)
    own, shape, flags = cache.look_up(words, data, start[first], size[first])
    distinct = np.bincount(np.unique(text * len(words) + inverse) // max(len(words), 1), minlength=n_texts)
    keys = np.concatenate([text[f >= 0] * WIDTH + f[f >= 0] for f in (own[inverse].astype(np.int64), shape[inverse].astype(np.int64))])
    keys, counts = np.unique(keys, return_counts=True)
    row, feature = keys // WIDTH, keys % WIDTH
    weights = np.log1p(counts.astype(np.float64))
    norm = np.sqrt(np.bincount(row, weights=weights**2, minlength=n_texts))
    some = np.maximum(n, 1)
    lines = np.array([1 - len(set(x)) / len(x) for x in (t.split(b"\n") for t in texts)])
    shaped = np.bincount(row[feature < 1024], weights=counts[feature < 1024], minlength=n_texts)
    per = lambda bit: np.bincount(text[(flags[inverse] & bit) > 0], minlength=n_texts) / some
    marks = [_bucket(1 - distinct / some, 32), _bucket(per(1), 64), _bucket(per(2), 96), _bucket(lines, 128), 160 + np.minimum(15, np.frexp(n.astype(np.float64))[1]), _bucket(shaped / some, 192)]
    there = np.flatnonzero(n > 0)
    rows = np.concatenate([np.arange(n_texts), *[there] * len(marks), row])
    ids = np.concatenate([np.zeros(n_texts, dtype=np.int64), *[m[there] for m in marks], feature])
    values = np.concatenate([np.full(n_texts + len(there) * len(marks), 0.5), weights / np.where(norm > 0, norm, 1.0)[row] * 4])
    order = np.argsort(rows, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_texts)))), ids[order], values[order]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashed()
    for batch in slices(batches, "text", SLICE):
        offsets, ids, values = featurise(texts_of(batch), cache)
        o = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(o, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(o, pa.array(values.astype(np.float32)))], names=["grade", "ids", "vals"])


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, offsets: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        # Each row's sum is its own (a row has a bias at least): no digit of it depends on the rows beside it.
        z = np.add.reduceat(self.weights[ids] * values, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -50, 50)))


def objective(w: np.ndarray, free: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: np.ndarray, importance: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted mean of -log P(grade) with a ridge on the weights, and its gradients. free: the first threshold, and the logarithms of the gaps."""
    n = len(grades)
    cuts = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
    z = np.bincount(rows, weights=w[ids] * values, minlength=n)
    upper = np.hstack((np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None] - z[:, None], -50, 50))), np.zeros((n, 1))))
    a, b = upper[np.arange(n), grades], upper[np.arange(n), grades + 1]
    p = np.maximum(a - b, 1e-9)
    da, db = a * (1 - a), b * (1 - b)
    gz = -importance * (da - db) / p / n
    # The cut k lowers P(grade > k), which is a for grade k + 1 and b for grade k.
    gc = np.array([(importance * (np.where(grades == k + 1, da, 0) - np.where(grades == k, db, 0)) / p).sum() / n for k in range(GRADES - 1)])
    gw = np.bincount(ids, weights=gz[rows] * values, minlength=len(w)) + ridge * w
    gf = np.cumsum(gc[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
    return float((importance * -np.log(p)).sum() / n + ridge * (w * w).sum() / 2), gw, gf


def fit(offsets: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int = WIDTH, steps: int = STEPS, ridge: float = 1e-4) -> Model:
    """Adam on the likelihood of the cumulative-link model; thresholds as the first and log gaps, so that they stay ordered."""
    n, seen = len(grades), np.bincount(grades, minlength=GRADES)
    if (seen > 0).sum() < 2:
        best = int(seen.argmax()) if n else GRADES - 1
        return Model(np.zeros(width), np.where(np.arange(GRADES - 1) < best, -30.0, 30.0))
    importance = np.where(seen > 0, n / np.maximum(seen, 1), 0.0)[grades] ** 0.5
    importance /= importance.mean()
    rows = np.repeat(np.arange(n), np.diff(offsets))
    # A word of one or two documents can only be learned by heart.
    often = np.bincount(ids, minlength=width)[ids] >= LEAST_DOCUMENTS
    ids, values, rows = ids[often], values[often], rows[often]
    w, free = np.zeros(width), np.array([-1.0, *[0.0] * (GRADES - 2)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, steps + 1):
        _, gw, gf = objective(w, free, rows, ids, values, grades, importance, ridge)
        for x, g, m, v in ((w, gw, state[0], state[1]), (free, gf, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def grade(quality, toxic):
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most: int = SAMPLE_BYTES, longest: int = LONGEST, keep: float = 1.0) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, toxic. keep: the share of labelled ids to train on (tests hold out the rest)."""
    ship(docs.sparkSession)
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    place = F.xxhash64(F.lit(7), "doc_id")
    rated = rated.filter(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1000)) < int(1000 * keep))
    # The bounds of the fit, see above; everything else covers all rows.
    chosen = rated.orderBy(place, "doc_id").limit(sample)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.sum("n").alias("n")).filter(F.col("n") <= longest)
    so_far = F.sum("n").over(Window.orderBy(place, "doc_id"))  # over at most `sample` rows
    chosen = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= most).select("doc_id", "grade")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("grade", "text").mapInArrow(_sparse, "grade int, ids array<int>, vals array<float>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    rows = rows.combine_chunks()
    ids, vals = rows.column(1).chunk(0), rows.column(2).chunk(0)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    return fit(offsets - offsets[0], ids.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), vals.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.float64), rows.column(0).to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, expected_grade, p_above_0 and p_above_1."""
    ship(docs.sparkSession)
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = Hashed(), Model(weights.astype(np.float64), cuts)
        for batch in slices(batches, "text", SLICE):
            p = own.score(*featurise(texts_of(batch), cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), *[pa.array(p[:, k]) for k in range(GRADES - 1)]], names=["id", "expected_grade", *[f"p_above_{k}" for k in range(GRADES - 1)]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, f"id {kind}, expected_grade double, " + ", ".join(f"p_above_{k} double" for k in range(GRADES - 1))).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """The documents (all columns) whose probability of the best grade is at least tail."""
    ship(docs.sparkSession)
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = Hashed(), Model(weights.astype(np.float64), cuts)
        for batch in slices(batches, text_col, SLICE):
            p = own.score(*featurise(texts_of(batch, text_col), cache))
            yield batch.filter(pa.array(p[:, -1] >= tail))

    # Columns go by place, so that no name of theirs has to be resolved.
    names = [f"c{i}" if c != text_col else c for i, c in enumerate(docs.columns)]
    renamed = docs.toDF(*names)
    return renamed.mapInArrow(kept, renamed.schema).toDF(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", "expected_grade", F.col("p_above_0").alias("p_not_toxic"), F.col("p_above_1").alias("p_good"), (F.col("p_above_1") >= TAIL).alias("kept"))
