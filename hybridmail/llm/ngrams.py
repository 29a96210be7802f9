"""LM scoring with a trigram trie in Elias-Fano coded, memory-mapped levels.

Training documents (by a hash of the id, a share is held out) give counts of all words, of all pairs of neighbours, and of
the triples below; a document's last word is followed by an end token, which is also what its first word follows.

Level 1 lists the words in the order of their 64-bit hashes (then bytes), so that a word's id is its rank: hashes, the
words' bytes, counts and the quantised weight of backing off from it, cut into files by the sizes of the counting
partitions. A word is found by its hash and then compared byte by byte; words of one hash are different words.

Level 2 is cut into shards of about SHARD pairs at most by cut points on (context, word), so that a frequent context spreads
over several. A shard is a trie level: the ascending contexts, a monotone pointer from each to its first successor, and the
successors, each context's words raised by the last successor before them so that they ascend over the whole shard; all
three Elias-Fano coded. Each successor has its discounted probability, quantised to 16 bits of its logarithm. A query finds
the context, reads its two pointers, and searches its successor between them, relative to the one before.

Level 3 hangs on level 2, shard by shard: its contexts are places of pairs in the shard. Pruning, of the model alone: a pair
is a context if it was seen CONTEXT times at least, and a triple is kept if it was seen KEPT times at least. All training
text is read for it, and the discounts of the triples that are pruned go to the backing-off weight.

P(w | u) = max(c(u, w) - D, 0) / c(u) + D * types(u) / c(u) * P(w), and P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), where a
word that was never seen counts as one more; after an unseen word P(w) stands alone. P(w | u, v) = (c(u, v, w) - D) / c(u, v)
for a kept triple, else 0, plus what the kept ones leave of one times P(w | v); where (u, v) is no context, P(w | v). The
probabilities of each context sum to one, up to the quantisation (a relative error below QUANTUM * ln 10 / 2 in each factor).

Null and empty texts are the end token alone. A null id counts as held out: nothing is learned from it. Repeated rows count
each. Without training documents V and N are 0 and every token has probability one. Other columns are not read. Two words of
one hash are told apart by their bytes everywhere. Levels are mapped from the shared folder; where that is no file system of
the machine, each worker maps copies of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.llm.common import eights, forget, give_back, partitions, same_stretches, scratch, ship, slices, stored, table, texts_of
from hybridmail.llm.eliasfano import EliasFano, mapped, mapped_sequence, write_array, write_parts
from hybridmail.llm.substrings import hash_stretches, word_edges

DISCOUNT = 0.75
#: Pruning of level 3: how often a context and a triple were seen at least.
CONTEXT, KEPT = 8, 2
#: Pairs of a shard, about.
SHARD = 4_000_000
#: Step of the quantised base-10 logarithms.
QUANTUM = 1 / 4096
#: One document of so many is looked at for the cut points of the shards, which decide balance only.
CUT_SAMPLE = 64
END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
_SIGN = np.uint64(1 << 63)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-15)) / QUANTUM), 0, 65535).astype("<u2")


def restored(q: np.ndarray) -> np.ndarray:
    return np.power(10.0, -QUANTUM * q.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(True))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, a place where each stands, and which of them each number is."""
    order = np.argsort(x)
    line = x[order]
    new = np.concatenate(([True], line[1:] != line[:-1])) if len(x) else np.zeros(0, dtype=bool)
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return line[new], order[new], inverse


class Tokens:
    """The tokens of all texts, ends included: hashes, those of the distinct ones in ascending order (one for each word, so that words of one hash repeat it) with a place where each stands, and where each text begins."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([*(t.lower() for t in texts), b"\0" * 8])
        edges = len(self.data) - 8
        start, size = word_edges(self.data[:edges])
        begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
        bounds = np.searchsorted(start, begins)
        self.line = np.insert(hash_stretches(self.data, start, size), bounds[1:], END)
        self.bounds = bounds + np.arange(len(bounds))
        self.start, self.size = np.insert(start, bounds[1:], 0), np.insert(size, bounds[1:], 0)
        self.own, self.first, self.inverse = _distinct(self.line)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        place = self.first[self.inverse]
        again = np.flatnonzero(place != np.arange(len(place)))
        place = place[again]
        view = eights(self.bytes)
        same = self.size[again] == self.size[place]
        same[same] = same_stretches(view, self.start[again[same]], view, self.start[place[same]], self.size[again[same]])
        if not same.all():
            self._tell_apart(self.inverse[again[~same]])

    def _tell_apart(self, shared: np.ndarray) -> None:
        """Words of one hash, which is rare: their hash stands once for each of them, in the order of their bytes."""
        at = np.flatnonzero(np.isin(self.inverse, shared))
        words = [(int(k), self.data[a : a + n]) for k, a, n in zip(self.inverse[at], self.start[at], self.size[at], strict=True)]
        place = dict(zip(reversed(words), reversed(at.tolist()), strict=True))  # the first of each
        several = sorted(place)
        alone = np.setdiff1d(np.arange(len(self.own)), shared)
        before = np.concatenate((alone, np.array([k for k, _ in several], dtype=np.int64)))
        order = np.argsort(before, kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        of = dict(zip(several, number[len(alone) :].tolist(), strict=True))
        first = np.concatenate((self.first[alone], np.array([place[w] for w in several], dtype=np.int64)))[order]
        changed = np.empty(len(self.own), dtype=np.int64)
        changed[alone] = number[: len(alone)]
        self.own, self.first, self.inverse = self.own[before[order]], first, changed[self.inverse]
        self.inverse[at] = [of[w] for w in words]

    def word(self, i: int) -> bytes:
        """Of the i-th distinct token."""
        at = self.start[self.first[i]]
        return self.data[at : at + self.size[self.first[i]]]


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums n by two numbers that aren't negative, in their order."""
    if not len(a):
        return a, b, n
    wide = int(b.max()) + 1
    # Both numbers as one where they fit: one sort instead of two.
    order = np.argsort(a * wide + b) if (int(a.max()) + 1) * wide < 2**63 else np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(n, first)


class _Counts:
    """Sums counts by two numbers in bounded memory: gives them out when there are many."""

    def __init__(self, most: int = 1_500_000):
        self.parts, self.held, self.most = [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...] | None:
        self.parts.append(_summed(a, b, np.ones(len(a), dtype=np.int64)))
        self.held += len(self.parts[-1][0])
        return self.take() if self.held > self.most else None

    def take(self) -> tuple[np.ndarray, ...] | None:
        if not self.held:
            return None
        got = _summed(*map(np.concatenate, zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        return got


class _WordCounts:
    """Sums counts by word in bounded memory; words are found by hash and compared by bytes."""

    def __init__(self, most: int = 600_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.hashes, self.at = np.zeros(0, dtype=np.uint64), none  # ascending hashes, and the number of each one's word
        self.start, self.size, self.counts = none, none, none  # by number
        self.bytes, self.filled = np.zeros(1 << 18, dtype=np.uint8), 0

    def add(self, t: Tokens) -> Iterator[pa.RecordBatch]:
        n = np.bincount(t.inverse, minlength=len(t.own))
        start, size = t.start[t.first], t.size[t.first]
        place = np.searchsorted(self.hashes, t.own)
        hit = np.zeros(len(t.own), dtype=bool)
        if len(self.hashes):
            hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == t.own
            known = self.at[place[hit]]
            same = self.size[known] == size[hit]
            if not same.all() or not same_stretches(eights(self.bytes), self.start[known], eights(t.bytes), start[hit], size[hit]).all():
                yield from self.take()  # two words of one hash: each in a row of its own
                yield from self.add(t)
                return
            self.counts[known] += n[hit]
        new = np.flatnonzero(~hit)
        if len(new):
            line = b"".join([t.data[a : a + k] for a, k in zip(start[new].tolist(), size[new].tolist(), strict=True)])
            if self.filled + len(line) + 8 > len(self.bytes):
                self.bytes = np.concatenate((self.bytes, np.zeros(max(len(line) + 8, len(self.bytes) // 2), dtype=np.uint8)))
            self.bytes[self.filled : self.filled + len(line)] = np.frombuffer(line, dtype=np.uint8)
            self.hashes, self.at = np.insert(self.hashes, place[new], t.own[new]), np.insert(self.at, place[new], len(self.size) + np.arange(len(new)))
            self.start = np.concatenate((self.start, self.filled + np.cumsum(size[new]) - size[new]))
            self.size, self.counts = np.concatenate((self.size, size[new])), np.concatenate((self.counts, n[new]))
            self.filled += len(line)
        if len(self.hashes) > self.most:
            yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        if not len(self.hashes):
            return
        edges = pa.py_buffer(np.append(self.start, self.filled).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(self.size), [None, edges, pa.py_buffer(self.bytes[: self.filled].copy())])
        # The sign bit is flipped, so that the order as signed numbers is that of the hashes.
        yield pa.RecordBatch.from_arrays([pa.array((self.hashes ^ _SIGN).view(np.int64)), words.take(pa.array(self.at)), pa.array(self.counts[self.at])], names=["h", "word", "n"])
        self._clear()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _WordCounts()
    for batch in slices(batches, "text"):
        yield from counts.add(Tokens(texts_of(batch)))
    yield from counts.take()


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():05d}-{context.taskAttemptId()}"


def _write_words(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            h = np.concatenate([b.column(0).to_numpy() for b in got]).view(np.uint64) ^ _SIGN
            n = np.concatenate([b.column(2).to_numpy() for b in got])
            words = [w for b in got for w in b.column(1).to_pylist()]
            uri = f"{folder}/words-{_attempt()}"
            write_array(f"{uri}.hashes.npy", h)
            write_array(f"{uri}.counts.npy", n.astype("<i8"))
            write_array(f"{uri}.edges.npy", np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))))).astype("<i8"))
            write_array(f"{uri}.bytes.npy", np.frombuffer(b"".join([*words, b"\0" * 8]), dtype=np.uint8))
            yield pa.RecordBatch.from_pydict({"uri": [uri], "first": pa.array((h[:1] ^ _SIGN).view(np.int64)), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return write


@dataclass(frozen=True)
class Words:
    """Level 1: its files in the order of the hashes, and where the ids of each begin."""

    files: tuple[str, ...]
    starts: tuple[int, ...]
    firsts: tuple[int, ...]
    size: int
    tokens: int
    backoffs: tuple[str, ...] = ()


@lru_cache(maxsize=16)
def _maps(files: tuple[str, ...], kind: str) -> list[np.ndarray]:
    return [mapped(f"{f}.{kind}.npy") for f in files]


def _gather(words: Words, files: tuple[str, ...], kind: str, ids: np.ndarray) -> np.ndarray:
    """Values of ascending ids."""
    cuts = np.append(np.searchsorted(ids, words.starts), len(ids))
    parts = [m[ids[a:b] - s] for m, s, a, b in zip(_maps(files, kind), words.starts, cuts[:-1], cuts[1:], strict=True) if b > a]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def ids_of(words: Words, hashes: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of words by ascending hashes, their bytes (as eights()) compared; words.size for those that aren't there."""
    out = np.full(len(hashes), words.size, dtype=np.int64)
    cuts = np.append(np.searchsorted(hashes, np.array(words.firsts, dtype=np.uint64)), len(hashes))
    # Words of one hash lie in one file: files are cut between hashes.
    kinds = zip(*(_maps(words.files, kind) for kind in ("hashes", "edges", "bytes")), words.starts, cuts[:-1], cuts[1:], strict=True)
    for known, edges, blob, first, a, b in kinds:
        view = eights(blob)
        left = np.arange(a, b)
        at = np.searchsorted(known, hashes[left])
        while len(left):
            there = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes[left]))
            left, at = left[there], at[there]
            same = edges[at + 1] - edges[at] == size[left]
            same[same] = same_stretches(view, edges[at[same]], text, start[left[same]], size[left[same]])
            out[left[same]] = first + at[same]
            left, at = left[~same], at[~same] + 1
    return out


def token_ids(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the tokens of all texts, ends included, and where each text begins."""
    t = Tokens(texts)
    return ids_of(words, t.own, eights(t.bytes), t.start[t.first], t.size[t.first])[t.inverse], t.bounds


def _encoded(words: Words):
    """doc_id and the ids of all tokens; words.size stands for an unknown one."""
    kind = np.int32 if words.size < 2**31 else np.int64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, bounds = token_ids(words, texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(kind)))], names=["doc_id", "ids"])

    return encode


def encode(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id and the ids of its tokens."""
    kind = docs.schema[id_col].dataType.simpleString() if id_col in docs.columns else "long"
    rows = docs.select((F.col(id_col) if id_col in docs.columns else F.lit(None).cast("long")).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(words), f"doc_id {kind}, ids array<{'int' if words.size < 2**31 else 'bigint'}>")


def _lines(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Encoded documents in parts of about so many tokens, a document always whole: rows, ids, and where each text begins."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ends = lists.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            ids = lists.values[int(ends[first]) : int(ends[last])].to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.slice(first, last - first), ids, ends[first : last + 1] - ends[first]
            first = last
    give_back()


@lru_cache(maxsize=8)
def end_of(words: Words) -> int:
    return int(ids_of(words, np.array([END]), eights(np.zeros(8, dtype=np.uint8)), np.array([0]), np.array([0]))[0])


def _before(ids: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate(([end], ids[:-1]))


def _packed(shard: np.ndarray, key: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    """A row for each shard (ascending) with all its numbers in one value: 64-bit keys, more 64-bit numbers, 32-bit counts last."""
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    columns = [key.astype("<i8"), *(x.astype("<i8") for x in rest[:-1]), rest[-1].astype("<i4")]
    values = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int32)), *values], names=["shard", *PACKED[: len(values) - 1], "n"])


#: Names of packed columns.
PACKED = ("key", "word")


def _count_pairs(words: Words, cuts: np.ndarray | None):
    """Pairs with counts and the shard of each; without cuts, the keys alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()

        def rows(got):
            context, word, n = got
            keys = context * words.size + word
            if cuts is None:
                return pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])
            return _packed(np.searchsorted(cuts, keys, "right"), keys, n)

        for _, ids, _ in _lines(batches):
            if got := counts.add(_before(ids, end_of(words)), ids):
                yield rows(got)
        if got := counts.take():
            yield rows(got)

    return count


def _write_level(uri: str, contexts: np.ndarray, begin: np.ndarray, word: np.ndarray, weights: np.ndarray) -> None:
    """Contexts (ascending), where the successors of each begin, and all successors (ascending within each context)."""
    until = np.append(begin[1:], len(word))
    base = np.concatenate(([0], np.cumsum(word[until - 1] + 1)[:-1])) if len(begin) else begin
    write_parts(f"{uri}.contexts", EliasFano.build(contexts).parts())
    write_parts(f"{uri}.pointers", EliasFano.build(np.append(begin, len(word))).parts())
    write_parts(f"{uri}.successors", EliasFano.build(np.repeat(base, until - begin) + word).parts())
    write_array(f"{uri}.weights.npy", quantised(weights))


def _gathered(finish):
    """Hands the rows of each shard of a partition (as a rule it has one) to finish(shard, columns)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            shards, *columns = (c.to_pylist() for c in batch.columns)
            for s, *values in zip(shards, *columns, strict=True):
                held.setdefault(s, []).append((*(np.frombuffer(x, dtype="<i8") for x in values[:-1]), np.frombuffer(values[-1], dtype="<i4")))
        for s in sorted(held):
            yield from finish(s, [np.concatenate(c) for c in zip(*held.pop(s), strict=True)])

    return build


def _build_shards(words: Words, folder: str, discount: float):
    """One trie level for each shard of pairs; gives its files and its contexts' numbers of successors."""

    def finish(shard: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        context, word, n = _summed(columns[0] // words.size, columns[0] % words.size, columns[1].astype(np.int64))
        columns.clear()
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        types = np.diff(np.append(begin, len(word)))
        own = context[begin]
        uri = f"{folder}/pairs-{shard:05d}-{_attempt()}"
        _write_level(uri, own, begin, word, (n - discount) / np.repeat(_gather(words, words.files, "counts", own), types))
        write_array(f"{uri}.often.npy", n >= CONTEXT)
        for i in range(0, len(own), 1 << 17):
            part = slice(i, i + (1 << 17))
            size = len(own[part])
            yield pa.RecordBatch.from_arrays([pa.array([shard] * size, pa.int32()), pa.array([uri] * size), pa.array(own[part]), pa.array(types[part])], names=["shard", "uri", "context", "types"])

    return _gathered(finish)


def _spread(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning sends there, so that shards meet in none."""
    tried = spark.range(40 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id").cast("int").alias("i"))
    found = {r["p"]: r["i"] for r in tried.groupBy("p").agg(F.min("i").alias("i")).collect()}
    return [found.get(p, p) for p in range(n)]


def _write_backoffs(words: Words, folder: str, discount: float):
    """For each file of level 1, the quantised weights of backing off: rows (file, place, types) sorted by file and place."""

    def finish(number: int, place: np.ndarray, types: np.ndarray) -> pa.RecordBatch:
        counts = _maps(words.files, "counts")[number]
        out = np.zeros(len(counts), dtype="<u2")
        out[place] = quantised(discount * types / np.maximum(counts[place], 1))
        uri = f"{folder}/backoffs-{number:05d}-{_attempt()}"
        write_array(f"{uri}.backoffs.npy", out)
        return pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "uri": [uri]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, types = None, [], []
        for batch in batches:
            numbers, p, t = (batch.column(i).to_numpy() for i in range(3))
            for s in np.unique(numbers).tolist():
                if now is not None and s != now:
                    yield finish(now, np.concatenate(places), np.concatenate(types))
                    places, types = [], []
                now = s
                places.append(p[numbers == s])
                types.append(t[numbers == s])
        if now is not None:
            yield finish(now, np.concatenate(places), np.concatenate(types))

    return write


@dataclass(frozen=True)
class Model:
    words: Words
    shards: tuple[str, ...]
    cuts: tuple[int, ...]
    numbers: tuple[int, ...]
    #: Level 3 of each shard; empty where it has none.
    triples: tuple[str, ...] = ()


@lru_cache(maxsize=1 << 14)
def _sequence(uri: str) -> EliasFano:
    return mapped_sequence(uri)


@lru_cache(maxsize=1 << 14)
def _array(uri: str, kind: str) -> np.ndarray:
    return mapped(f"{uri}.{kind}.npy")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an ascending array, and which of them each is."""
    new = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=bool)
    return x[new], np.cumsum(new) - 1


def successors(uri: str, place: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where in a level's successors each word stands after the context of each place (ascending), or -1: sought between the context's pointers."""
    line = _sequence(f"{uri}.successors")
    own, inverse = _runs(place)
    low, high = _sequence(f"{uri}.pointers").access_two(own)
    base = np.where(low > 0, line.access(np.maximum(low - 1, 0)) + 1, 0)
    return line.find(base[inverse] + word, low[inverse], high[inverse])


def pair_places(model: Model, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs in ascending order of context, then word: the shard (as place in model.shards) and the place in it of each, -1 where it wasn't seen."""
    keys = context * model.words.size + word
    shard, at = np.full(len(keys), -1, dtype=np.int32), np.full(len(keys), -1, dtype=np.int64)
    edges = np.searchsorted(keys, np.array(model.cuts, dtype=np.int64)) if model.cuts else np.zeros(0, dtype=np.int64)
    edges = np.concatenate(([0], edges, [len(keys)]))
    for i, (number, uri) in enumerate(zip(model.numbers, model.shards, strict=True)):
        a, b = edges[number], edges[number + 1]
        if a == b:
            continue
        own, inverse = _runs(context[a:b])
        place = _sequence(f"{uri}.contexts").find(own)[inverse]
        there = np.flatnonzero(place >= 0)
        found = successors(uri, place[there], word[a:b][there])
        hit = found >= 0
        shard[a + there[hit]], at[a + there[hit]] = i, found[hit]
    return shard, at


def _valued(model: Model, shard: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """A value of each pair that was seen; shard ascends but for -1."""
    out = np.zeros(len(at), dtype=bool if kind == "often" else "<u2")
    for i in np.unique(shard[shard >= 0]).tolist():
        mine = np.flatnonzero(shard == i)
        out[mine] = _array(model.shards[i], kind)[at[mine]]
    return out


class _Line:
    """A line of tokens (each text ends with the end token), its distinct pairs, and where each was seen."""

    def __init__(self, model: Model, ids: np.ndarray, end: int):
        size = model.words.size
        context = _before(ids, end)
        self.known = np.flatnonzero((context < size) & (ids < size))
        keys, _, self.inverse = _distinct(context[self.known] * size + ids[self.known])
        self.shard, self.at = pair_places(model, keys // size, keys % size)
        #: For each token, the distinct pair that it ends, or -1.
        self.pair = np.full(len(ids), -1, dtype=np.int64)
        self.pair[self.known] = self.inverse
        #: For each token, the distinct pair before it, or -1: a text's first token has none.
        self.before = np.concatenate(([-1], self.pair[:-1]))
        self.before[context == end] = -1


def _count_triples(model: Model):
    """Triples after pairs that were seen often: shard, place of the pair in it, word, count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, end = _Counts(), end_of(model.words)

        def rows(got):
            node, word, n = got
            return _packed(node >> 32, node & (2**32 - 1), word, n)

        for _, ids, _ in _lines(batches):
            line = _Line(model, ids, end)
            often = np.append(_valued(model, line.shard, line.at, "often"), False)[line.before]
            node = (line.shard.astype(np.int64) << 32 | line.at)[line.before[often]]
            if got := counts.add(node, ids[often]):
                yield rows(got)
        if got := counts.take():
            yield rows(got)

    return count


def _build_triples(folder: str, discount: float):
    """Level 3 of each shard; gives its files."""

    def finish(shard: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, word, n = _summed(columns[0], columns[1], columns[2].astype(np.int64))
        columns.clear()
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        totals = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
        kept = n >= KEPT
        place, word, weights = place[kept], word[kept], ((n - discount) / totals)[kept]
        if not len(place):
            return
        begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        uri = f"{folder}/triples-{shard:05d}-{_attempt()}"
        _write_level(uri, place[begin], begin, word, weights)
        # What the kept triples, as they are stored, leave of one.
        write_array(f"{uri}.backoffs.npy", quantised(1 - np.add.reduceat(restored(quantised(weights)), begin)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri]})

    return _gathered(finish)


def lexicon(docs: DataFrame) -> Words:
    """Level 1 of the texts of docs, still without weights of backing off. The files lie in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    folder, n = scratch(spark, "words"), partitions(spark)
    counted = docs.select("text").mapInArrow(_count_words, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))
    counted, counted_path = stored(counted, "word-counts")
    files, files_path = stored(counted.repartitionByRange(n, "h").sortWithinPartitions("h", "word").mapInArrow(_write_words(folder), "uri string, first long, words long, tokens long"), "word-files")
    files = files.orderBy("first").collect()  # a row for each partition
    sizes = [r["words"] for r in files]
    if (sum(sizes) + 1) ** 2 >= 2**63:
        raise ValueError("more distinct words than pairs of their numbers have room for in 63 bits (3,037,000,498)")
    words = Words(tuple(r["uri"] for r in files), tuple(int(x) for x in np.cumsum([0, *sizes[:-1]])) if files else (), tuple(r["first"] + 2**63 for r in files), sum(sizes), sum(r["tokens"] for r in files))
    forget(spark, counted_path, files_path)
    return words


def train(docs: DataFrame, *, discount: float = DISCOUNT) -> Model:
    """docs: text. Counts all of them."""
    words = lexicon(docs)
    encoded, path = stored(encode(docs, words), "encoded")
    model = build(encoded, words, discount=discount)
    forget(docs.sparkSession, path)
    return model


def build(encoded: DataFrame, words: Words, *, discount: float = DISCOUNT) -> Model:
    """Levels 2 and 3 of the training documents, as encode() gives them; read more than once."""
    spark = encoded.sparkSession
    if not words.files:
        return Model(words, (), (), ())
    folder, n = scratch(spark, "ngrams"), partitions(spark)
    texts = encoded.select("ids")
    some, some_path = stored(texts.filter(F.pmod(F.xxhash64("ids"), F.lit(CUT_SAMPLE)) == 0).mapInArrow(_count_pairs(words, None), "key long"), "pair-sample")
    n_shards = max(n, math.ceil(CUT_SAMPLE * some.count() / SHARD))
    cuts = some.agg(F.percentile_approx("key", [i / n_shards for i in range(1, n_shards)], 20_000).alias("c")).first()["c"] if n_shards > 1 else None
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))
    to = F.element_at(F.array(*map(F.lit, _spread(spark, n_shards))), F.col("shard") + 1)
    pairs = texts.mapInArrow(_count_pairs(words, cuts), "shard int, key binary, n binary")
    built, built_path = stored(pairs.repartition(n_shards, to).mapInArrow(_build_shards(words, folder, discount), "shard int, uri string, context long, types long"), "pair-shards")
    shards = built.select("shard", "uri").distinct().orderBy("shard").collect()  # a row for each shard
    starts = F.array(*[F.lit(x) for x in words.starts])
    number = F.size(F.filter(starts, lambda s: s <= F.col("context"))) - 1
    types = built.groupBy("context").agg(F.sum("types").alias("types")).select(number.cast("int").alias("number"), "context", "types")
    types = types.select("number", (F.col("context") - F.element_at(starts, F.col("number") + 1)).alias("place"), "types")
    backoffs, backoffs_path = stored(types.repartition(n, "number").sortWithinPartitions("number", "place").mapInArrow(_write_backoffs(words, folder, discount), "number int, uri string"), "backoffs")
    by_number = {r["number"]: r["uri"] for r in backoffs.collect()}
    forget(spark, some_path, built_path, backoffs_path)
    # A file none of whose words is a context can't be: every word is followed by something.
    words = Words(words.files, words.starts, words.firsts, words.size, words.tokens, tuple(by_number[i] for i in range(len(words.files))))
    model = Model(words, tuple(r["uri"] for r in shards), tuple(cuts.tolist()), tuple(r["shard"] for r in shards))
    triples = texts.mapInArrow(_count_triples(model), "shard int, key binary, word binary, n binary")
    thirds, thirds_path = stored(triples.repartition(n_shards, to).mapInArrow(_build_triples(folder, discount), "shard int, uri string"), "triple-shards")
    uris = {r["shard"]: r["uri"] for r in thirds.collect()}  # a row for each shard
    forget(spark, thirds_path)
    return Model(words, model.shards, model.cuts, model.numbers, tuple(uris.get(i, "") for i in range(len(model.shards))))


def _thirds(model: Model, line: _Line, ids: np.ndarray, p: np.ndarray) -> None:
    """Brings in level 3: p holds the probabilities by level 2."""
    if not len(line.at):
        return
    place = np.full(len(line.at) + 1, -1, dtype=np.int64)  # of each distinct pair among the contexts of its shard
    for i in np.unique(line.shard[line.shard >= 0]).tolist():
        if model.triples[i]:
            mine = np.flatnonzero(line.shard == i)
            mine = mine[_array(model.shards[i], "often")[line.at[mine]]]
            place[mine] = _sequence(f"{model.triples[i]}.contexts").find(line.at[mine])
    tokens = np.flatnonzero(place[line.before] >= 0)
    if not len(tokens):
        return
    pair = line.before[tokens]
    shard = line.shard[pair]
    order = np.argsort(pair, kind="stable")  # distinct pairs are in the order of their shards
    tokens, pair, shard = tokens[order], pair[order], shard[order]
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        uri, some = model.triples[shard[a]], tokens[a:b]
        at, word = place[pair[a:b]], ids[some]
        p[some] *= restored(_array(uri, "backoffs")[at])
        known = np.flatnonzero(word < model.words.size)
        found = successors(uri, at[known], word[known])
        hit = found >= 0
        p[some[known[hit]]] += restored(_array(uri, "weights")[found[hit]])


def probabilities(model: Model, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For a line of tokens (each text ends with the end token): counts, and P(token | the two tokens before)."""
    words = model.words
    if not words.size:
        return np.zeros(len(ids), dtype=np.int64), np.ones(len(ids))
    own, _, inverse = _distinct(ids)
    known = own < words.size
    counts = np.zeros(len(own), dtype=np.int64)
    counts[known] = _gather(words, words.files, "counts", own[known])
    alone = (counts + 0.5) / (words.tokens + 0.5 * (words.size + 1))
    back = np.ones(len(own) + 1)
    back[:-1][known] = restored(_gather(words, words.backoffs, "backoffs", own[known]))
    back[-1] = restored(_gather(words, words.backoffs, "backoffs", np.array([end])))[0] if end < words.size else 1.0
    before = np.concatenate(([len(own)], inverse[:-1]))
    p = back[before] * alone[inverse]
    line = _Line(model, ids, end)
    seen = np.where(line.shard >= 0, restored(_valued(model, line.shard, line.at, "weights")), 0.0)
    p[line.known] += seen[line.inverse]
    _thirds(model, line, ids, p)
    return counts[inverse], p


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_tokens, n_known, base_score, score."""
    ship(docs.sparkSession)
    return score_encoded(encode(docs, model.words, id_col, text_col), model).withColumnRenamed("doc_id", id_col)


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = math.log10(model.words.tokens + 0.5 * (model.words.size + 1))
        for rows, ids, bounds in _lines(batches):
            counts, p = probabilities(model, ids, end_of(model.words))
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), np.log10(counts + 0.5) - total, np.log10(p))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return encoded.mapInArrow(scored, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = lexicon(docs.filter(~held_out(F.col("doc_id"))))
    encoded, path = stored(encode(docs, words), "encoded")  # once for training and scoring
    model = build(encoded.filter(~held_out(F.col("doc_id"))), words)
    scores, _ = stored(score_encoded(encoded, model), "scores")
    forget(spark, path)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
