"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set is that of its distinct shingles (SHINGLE words; the whole sequence where there are fewer). Documents
   of equal sets form a class; its smallest id stands for it, so copies are never compared with each other.
2. MinHash signatures in bands. Numbers of bands and rows are chosen so that a pair at the wanted similarity shares no
   band with probability at most MISS.
3. In each bucket the classes are compared with the smallest one (a star: as many pairs as members, however large the
   group). Links give components. Only pairs of one bucket whose components then still differ are compared in a second
   round, in blocks of TILE by TILE members, out of which only links come. Signatures alone are dealt to the blocks first;
   only the members of a block that have a likely pair in it are dealt again with their sets. Then every pair that shares
   a band is tested or connected: no connection is lost, and a group of near copies doesn't make all its pairs.
4. A pair's signatures are compared in batches. With a uniform prior the similarity given m matches of n is Beta(m + 1,
   n - m + 1); the pair is dropped as soon as the posterior probability of the wanted similarity is below PRUNE.
5. Survivors are confirmed on the full sets, of 64-bit shingle hashes: 100 * intersection >= percent * union.

Null and empty texts have an empty set: size 0, linked with nothing, a component of their own. Ids are integers. Null ids have no component
and are kept. Rows with one id are one node, linked by whichever of their texts; repeated rows are one node. An empty
table gives no rows. `dedup` passes on all columns; `find` reads id and text only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.llm.common import column, forget, give_back, integer_id, partitions, ship, slices, stored, table, texts_of
from hybridmail.llm.components import components
from hybridmail.llm.substrings import hashed, mix

MISS = 2e-5
PRUNE = 1e-6
BATCH = 24
MOST_HASHES = 150
#: Members of a bucket that are compared in one block with as many others.
TILE = 512
_U = np.uint64


def banding(similarity: float, miss: float = MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) within `most` hashes that miss a pair at the similarity with probability miss at most."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("too few hashes for this similarity")


@lru_cache
def least_matches(similarity: float, hashes: int, prune: float = PRUNE) -> dict[int, int]:
    """By number of hashes compared, the fewest matches with which a pair isn't dropped."""
    x = (np.arange(200_000) + 0.5) / 200_000
    out = {}
    for n in sorted({*range(BATCH, hashes, BATCH), hashes}):
        for m in range(n + 1):
            p = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(p - p.max())
            if p[x >= similarity].sum() >= prune * p.sum():
                out[n] = m
                break
    return out


def coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(1)
    return (draw.randint(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1)), draw.randint(0, 2**32, hashes, dtype=np.uint32)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; lower-cased A-Z."""
    line, bounds = hashed([t.lower() for t in texts])
    n = max(len(line) - shingle + 1, 0)
    rolled = np.zeros(n, dtype=_U)
    for k in range(shingle):
        rolled = mix(rolled ^ line[k : k + n], 40 + k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(line[a:b].tobytes(), seed=7)], dtype=_U))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (found >> _U(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 512):
        part = a[:, None] * low[None, i : i + 512]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _sketch(shingle: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows)
        for batch in slices(batches, "text"):
            sizes, f1, f2, signs, keys = [], [], [], [], []
            for found in shingle_sets(texts_of(batch), shingle):
                sizes.append(len(found))
                if not len(found):
                    for out in (f1, f2, signs, keys):
                        out.append(None)
                    continue
                h = xxhash.xxh3_128_intdigest(found.tobytes())
                f1.append((h >> 64) - 2**63)
                f2.append((h & (2**64 - 1)) - 2**63)
                least = signature(found, a, b)
                signs.append((least & np.uint32(0xFFFF)).astype("<u2").tobytes())
                keys.append([xxhash.xxh3_64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), seed=k) - 2**63 for k in range(bands)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "sign", "bands"])

    return sketch


def survivors(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (x[p], y[q]) of signatures survive the sequential test."""
    alive, matches, done = np.arange(len(p)), np.zeros(len(p), dtype=np.int64), 0
    for n, m in least.items():
        matches[alive] += (x[p[alive], done:n] == y[q[alive], done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= m], n
    return alive


def _signs(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, hashes)


def _likely(similarity: float, hashes: int):
    """Keeps the pairs whose signatures survive the sequential test."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(similarity, hashes)
        for batch in batches:
            if batch.num_rows:
                each = np.arange(batch.num_rows)
                kept = pa.array(survivors(_signs(batch.column(2), hashes), _signs(batch.column(3), hashes), each, each, least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])
        give_back()

    return likely


class Sets:
    """The members' full sets of one block, as bits over the shingles that two of them have at least: exact intersections of many pairs at once."""

    def __init__(self, column: pa.Array):
        found = [np.frombuffer(x, dtype=_U) for x in column.to_pylist()]
        self.sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        _, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        shared = counts > 1
        place = np.cumsum(shared) - 1
        words = int(shared.sum()) + 63 >> 6
        self.bits = np.zeros((len(found), words), dtype=_U)
        use = shared[inverse]
        rows, at = np.repeat(np.arange(len(found)), self.sizes)[use], place[inverse[use]]
        np.bitwise_or.at(self.bits, (rows, at >> 6), _U(1) << (at & 63).astype(_U))

    def similar(self, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        step = max(1, (1 << 20) // max(1, self.bits.shape[1]))
        both = np.concatenate([np.bitwise_count(self.bits[p[i : i + step]] & self.bits[q[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(p), step)] or [np.zeros(0, dtype=np.int64)])
        return 100 * both >= percent * (self.sizes[p] + self.sizes[q] - both)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks of rows sorted by their first three columns (key, i, j)."""
    held = None
    for batch in _with_last(batches):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        block = np.stack([held.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
        edges = np.concatenate(([0], edges, [held.num_rows] if batch is None else [])).astype(int)  # the last block may go on
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(int(edges[-1]))
    give_back()


def _apart(block: pa.RecordBatch, hashes: int, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the likely pairs between different labels in a block (members of tile i with those of tile j). Columns: key, i, j, tile, doc_id, label, sign."""
    i, j = (int(block.column(k)[0].as_py()) for k in (1, 2))
    tile, doc, label = (block.column(k).to_numpy() for k in (3, 4, 5))
    if (label == label[0]).all():
        return
    sign = _signs(block.column(6), hashes)
    own, other = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    step = max(1, 40_000 // max(1, len(other)))
    for k in range(0, len(own), step):
        p, q = np.repeat(own[k : k + step], len(other)), np.tile(other, len(own[k : k + step]))
        apart = (label[p] != label[q]) & ((doc[p] < doc[q]) | (i != j))
        p, q = p[apart], q[apart]
        got = survivors(sign, sign, p, q, least)
        yield p[got], q[got]


def _open_members(similarity: float, hashes: int):
    """The members of each block that have a likely pair in it, without their signatures' partners."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(similarity, hashes)
        for block in _blocks(batches):
            use = np.zeros(block.num_rows, dtype=bool)
            for p, q in _apart(block, hashes, least):
                use[p] = use[q] = True
            if use.any():
                yield block.filter(pa.array(use))

    return members


def _crossing(similarity: float, hashes: int, percent: int):
    """Links between different labels within each block: signatures first, then the full sets. Rows: key, i, j, tile, doc_id, label, sign, hashes, sorted by block."""

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(similarity, hashes)
        for block in _blocks(batches):
            doc, full = block.column(4).to_numpy(), None
            for p, q in _apart(block, hashes, least):
                if len(p):
                    full = full or Sets(block.column(7))
                    same = full.similar(p, q, percent)
                    x, y = doc[p[same]], doc[q[same]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return crossing


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = shingle_sets(texts_of(batch), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "hashes"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])
        give_back()

    return confirm


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    ship(spark)
    bands, rows = banding(percent / 100)
    hashes = bands * rows
    docs = df.select(integer_id(df, id_col).alias("doc_id"), column(text_col).alias("text"))
    sketched, sketched_path = stored(docs.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, n_shingles long, f1 long, f2 long, sign binary, bands array<long>"), "sketches")
    known = sketched.filter("f1 is not null and doc_id is not null")
    classes, classes_path = stored(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")), "classes")
    firsts = known.join(classes, ["f1", "f2", "doc_id"])
    buckets, buckets_path = stored(firsts.select("doc_id", F.explode("bands").alias("key")).distinct(), "buckets")
    hubs = buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).filter("hub < most").select("key", "hub")
    shared, shared_path = stored(buckets.join(hubs, "key"), "shared-buckets")
    signs = firsts.select("doc_id", "sign")
    wanted = shared.select("doc_id").distinct()
    sets, sets_path = stored(docs.join(wanted, "doc_id").select("doc_id", "text").mapInArrow(_sets(shingle), "doc_id long, hashes binary"), "shingle-sets")

    def tested(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("sign").alias("x")), "a").join(signs.select(F.col("doc_id").alias("b"), F.col("sign").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_likely(percent / 100, hashes), "a long, b long")

    def confirmed(likely: DataFrame) -> DataFrame:
        full = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    # Rows of one id with several texts are one node: their classes are linked as the id itself is.
    named = known.select("doc_id", "f1", "f2").join(classes.withColumnRenamed("doc_id", "first"), ["f1", "f2"])
    links, links_path = stored(confirmed(tested(shared.filter("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())), "star-links")
    label = components(links)
    labelled = shared.select("key", "doc_id").join(label, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n")).filter("l < m").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    left = labelled.join(open_keys, "key").join(signs, "doc_id").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    blocks = left.select("key", "tile", "doc_id", "label", "sign", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc_id", "label", "sign")
    dealt = lambda rows: rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    members, members_path = stored(dealt(blocks).mapInArrow(_open_members(percent / 100, hashes), blocks.schema), "open-members")
    crossing = dealt(members.join(sets, "doc_id").select(*blocks.columns, "hashes")).mapInArrow(_crossing(percent / 100, hashes, percent), "a long, b long")
    more, more_path = stored(crossing.distinct(), "cross-links")
    forget(spark, members_path, sets_path, shared_path, buckets_path)
    several = named.groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").select("doc_id", "least")
    by_id = named.join(several, "doc_id").filter("least < first").select(F.col("least").alias("a"), F.col("first").alias("b"))
    whole = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more).unionAll(by_id))
    rows_out = sketched.select("doc_id", "n_shingles", "f1", "f2").join(classes.withColumnRenamed("doc_id", "first"), ["f1", "f2"], "left").withColumn("node", F.coalesce("first", "doc_id"))
    found = rows_out.join(whole, "node", "left").select(F.col("doc_id"), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")).withColumnRenamed("doc_id", id_col)
    out, _ = stored(found, "groups")
    forget(spark, sketched_path, classes_path, links_path, more_path)
    return out


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df whose id is the smallest of its group, of equal rows with one id all."""
    gone = find(df, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")


#: The contract, written out: all pairs that share a shingle, and the closure of the links.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
     n as (select doc_id, count(*) as n from s group by doc_id),
     c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (s) where a.doc_id < b.doc_id group by all),
     e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
     l as (select x, y from e union all select y, x from e),
     r(a, b) as (select doc_id, doc_id from d union select r.a, l.y from r join l on r.b = l.x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least as component_id, doc_id = least as kept
from (select a as doc_id, min(b) as least from r group by a) left join n using (doc_id)
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), shingle=3, percent=85)
