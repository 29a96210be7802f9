"""Target-distribution importance resampling over bucket-partitioned inverted postings.

1. Both corpora are cut into blocks of rows as they are read. A block's words and word pairs are hashed to buckets (the
   crc32 of a pair follows from those of its words, so no pair is ever spelled out), and its postings (bucket, document,
   count) are sorted by bucket and written as one row for each shard, a run of SHARD buckets.
2. A bucket's totals are sums over the blocks' sums: s in the documents, t in the target texts, S and T in all.
3. Postings are dealt by shard, and within a shard over as many parts as its bytes ask for, so that a bucket that holds a
   third of all features is still many tasks. The totals of both corpora are co-grouped with each part, which works out
   the gains of its buckets and adds count * gain over the documents of each block: what leaves it is a sum for each
   document, not for each posting.
4. The sums are reduced by block, where the documents' ids and sizes lie. weight is the floored mean of a document's gains;
   the score adds Gumbel noise from a hash of the id, so that the best scores are a sample without replacement.
5. Ranks: documents are range-partitioned by (score, id, place); a partition's first rank is the sum of the sizes of those
   before it.

All arithmetic on counts and gains is in 64-bit integers; logarithms are in doubles. Null and empty texts have no features:
weight 0, their noise for a score, never drawn (they have fewer words than `least`). Each row is a document of its own,
repeated rows and ids included; rows of one id have one noise, and ties beyond the id go by the row's place. Null ids take the
noise of the empty id and come last among ties. Without target texts the gains compare with an empty corpus (t = T = 0).
No documents give no rows. A text is worked on whole, whatever its length. Other columns are not read. Ids are integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import column, edges, forget, give_back, integer_id, partitions, ship, slices, squeeze, stored, stretch, table, texts_of

BUCKETS = 10_000
#: Buckets of one shard.
SHARD = 200
#: Bytes of postings of one part of a shard, about.
PART = 48 << 20
#: Bytes of text of a block.
BLOCK = 4 << 20
#: Documents of fewer words aren't drawn; the share of the others that is.
LEAST, PERCENT = 20, 25
SEED = 7

#: The bytes of words: digits, a to z, and all of characters beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
#: Longer words are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """For each length up to _LONG and each byte of a crc32, what that byte becomes when so many bytes follow."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((_LONG + 1, 4, 256), dtype=np.uint32)
    out[0] = np.stack([values << np.uint32(8 * k) for k in range(4)])
    for n in range(_LONG):
        out[n + 1] = _CRC[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shift_tables().reshape(-1)


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crc32s add to the crc32 of a text that goes on for so many bytes (at most _LONG)."""
    at = sizes.astype(np.int64) * 1024
    out = _SHIFT[at + (crc & 255)]
    for k in range(1, 4):
        out ^= _SHIFT[at + k * 256 + (crc >> np.uint32(8 * k) & 255)]
    return out


def word_crcs(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32s of stretches of data, all at once, a byte of each at a time."""
    line = np.frombuffer(data, dtype=np.uint8)
    order = np.argsort(-size, kind="stable")
    at, left = start[order], -size[order]
    c = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(left, -_LONG, "left"))
    for k in range(int(-left[long]) if long < len(left) else 0):
        m = int(np.searchsorted(left, -k, "left"))
        c[long:m] = _CRC[(c[long:m] ^ line[at[long:m] + k]) & 255] ^ (c[long:m] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[at[i] : at[i] - left[i]])
    out = np.empty_like(c)
    out[order] = c
    return out


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each feature, and the number of words of each text."""
    data = b"\n".join([*(t.lower() for t in texts), b""])
    start, size = edges(data, _INSIDE)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
    words = np.diff(np.searchsorted(start, begins))
    text = np.repeat(np.arange(len(texts)), words)
    crc = word_crcs(data, start, size)
    first = np.flatnonzero(text[1:] == text[:-1])
    second = first + 1
    blank = np.uint32(zlib.crc32(b" "))
    ones = np.ones(len(first), dtype=np.int64)
    pair = shifted(shifted(crc[first], ones) ^ blank, np.minimum(size[second], _LONG)) ^ crc[second]
    for i in np.flatnonzero(size[second] > _LONG).tolist():
        a, b = first[i], second[i]
        pair[i] = zlib.crc32(data[start[b] : start[b] + size[b]], zlib.crc32(b" ", int(crc[a])))
    return np.concatenate((text, text[first])), np.concatenate((crc, pair)) % np.uint32(buckets), words


def _post(buckets: int, block_bytes: int, shard: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        bounds = np.arange(0, buckets + shard, shard)
        names = ["block", "shard", "docs", "keys", "counts", "sums", "ids", "words"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in slices(batches, "text", block_bytes):
            n, block = batch.num_rows, (part << 32) + k
            k += 1
            text, bucket, words = features(texts_of(batch), buckets)
            # Sorted by bucket, then text: the postings of the block.
            keys = bucket.astype(np.uint64) * np.uint64(n) + text.astype(np.uint64)
            keys = np.sort(keys.astype(np.uint32) if buckets * n < 2**32 else keys).astype(np.uint64)
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(new, len(keys)))
            keys = keys[new]
            at = np.searchsorted(keys, (bounds * n).astype(np.uint64))
            sums = np.bincount((keys // np.uint64(n)).astype(np.int64), weights=counts, minlength=bounds[-1]).astype(np.int64)
            rows = [[block, -1, n, None, None, None, batch.column(0).to_pylist(), words.tolist()]]
            for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    own = keys[a:b] - np.uint64(bounds[s] * n)
                    rows.append([block, s, n, squeeze(np.diff(own, prepend=np.uint64(0))), squeeze(counts[a:b]), sums[bounds[s] : bounds[s + 1]].tolist(), None, None])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        give_back()

    return post


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """The gain of each bucket: a thousand times the logarithm of how much likelier it is in the target, floored."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (float(all_s) + buckets) / ((s + 1) * (float(all_t) + buckets)))).astype(np.int64)


def _contribute(buckets: int):
    """Rows sorted by shard, part and kind: the totals of the shard's buckets in both corpora (kind 0) come first, then its postings (kind 1)."""

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray | None = None
        for batch in batches:
            blocks, sums = [], []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    own = gains(np.array(row["s"]), np.array(row["t"]), row["all_s"], row["all_t"], buckets)
                    continue
                n = row["docs"]
                keys = np.cumsum(stretch(row["keys"])).astype(np.int64)
                gained = stretch(row["counts"]).astype(np.int64) * own[keys // n]
                doc = keys % n
                order = np.argsort(doc, kind="stable")
                doc, gained = doc[order], gained[order]
                new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total = np.zeros(n, dtype=np.int64)
                total[doc[new]] = np.add.reduceat(gained, new)
                blocks.append(row["block"])
                sums.append(total)
            if blocks:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sums])))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sums)))], names=["block", "sums"])
        give_back()

    return contribute


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its documents (ids and words) last: adds up the sums of the shards."""
    total, now = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != now:
                now, total = row["block"], None
            if row["sums"] is not None:
                more = np.array(row["sums"], dtype=np.int64)
                total = more if total is None else total + more
            if row["ids"] is None:
                continue
            words = np.array(row["words"], dtype=np.int64)
            n = words + np.maximum(words - 1, 0)
            total = np.zeros(len(words), dtype=np.int64) if total is None else total
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(words), pa.int64()), pa.array(np.arange(len(words))), pa.array(row["ids"], pa.int64()), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["block", "place", "doc_id", "n_words", "n_features", "weight"])


def postings(df: DataFrame, text_col: str, id_col: str | None, buckets: int = BUCKETS, name: str = "postings") -> tuple[DataFrame, str]:
    """The blocks of a corpus, written: a row for each block and shard, and one (shard -1) with the ids and word counts of its documents."""
    ship(df.sparkSession)
    ids = integer_id(df, id_col) if id_col else F.lit(None).cast("long")
    rows = df.select(ids.alias("id"), column(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(_post(buckets, BLOCK, SHARD), "block long, shard int, docs long, keys binary, counts binary, sums array<long>, ids array<long>, words array<long>"), name, compression="zstd")


def _totals(blocks: DataFrame, name: str) -> DataFrame:
    """shard, name (the sums of its buckets): at most a row for each shard."""
    each = blocks.filter("shard >= 0").select("shard", F.posexplode("sums").alias("k", "n")).groupBy("shard", "k").agg(F.sum("n").alias("n"))
    return each.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias(name))


def weights(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """A row for each row of docs: block and place (which row it is), doc_id, n_words, n_features, weight."""
    spark = docs.sparkSession
    blocks, blocks_path = postings(docs, text_col, id_col, buckets)
    wanted, wanted_path = postings(target, target_col, None, buckets, "target-postings")
    shards = math.ceil(buckets / SHARD)
    zeros = F.array_repeat(F.lit(0).cast("long"), SHARD)
    totals = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(_totals(blocks, "s"), "shard", "left").join(_totals(wanted, "t"), "shard", "left").select("shard", F.coalesce("s", zeros).alias("s"), F.coalesce("t", zeros).alias("t"))
    held = {r["shard"]: r for r in totals.collect()}  # a row for each shard: numbers of buckets, not of documents
    all_s, all_t = (sum(sum(r[k]) for r in held.values()) for k in ("s", "t"))
    sizes = {r["shard"]: r["n"] for r in blocks.filter("shard >= 0").groupBy("shard").agg(F.sum(F.octet_length("keys") + F.octet_length("counts")).alias("n")).collect()}
    # `part` of a totals row comes from its shard's number of parts; a posting's from its block.
    parts = spark.createDataFrame([(s, max(1, math.ceil(sizes.get(s, 0) / PART)), list(r["s"]), list(r["t"])) for s, r in held.items()], "shard int, parts int, s array<long>, t array<long>")
    none = lambda kind: F.lit(None).cast(kind)
    known = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none("long").alias("block"), none("long").alias("docs"), none("binary").alias("keys"), none("binary").alias("counts"), "s", "t", F.lit(all_s).cast("long").alias("all_s"), F.lit(all_t).cast("long").alias("all_t"))
    posts = blocks.filter("shard >= 0").join(F.broadcast(parts.select("shard", "parts")), "shard").select("shard", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "block", "docs", "keys", "counts", *[none(k).alias(c) for c, k in (("s", "array<long>"), ("t", "array<long>"), ("all_s", "long"), ("all_t", "long"))])
    met = known.unionByName(posts).repartition(partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "kind")
    sums = met.mapInArrow(_contribute(buckets), "block long, sums array<long>")
    rows = sums.select("block", "sums", none("array<long>").alias("ids"), none("array<long>").alias("words"), F.lit(0).alias("kind")).unionByName(blocks.filter("shard = -1").select("block", none("array<long>").alias("sums"), "ids", "words", F.lit(1).alias("kind")))
    found = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind").mapInArrow(_reduce, "block long, place long, doc_id long, n_words long, n_features long, weight long")
    out, _ = stored(found, "weights")
    forget(spark, blocks_path, wanted_path)
    return out


def noise(id_col: str, seed: int = SEED):
    """A thousand times standard Gumbel noise, floored, from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least: int = LEAST, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """A row for each row of docs: doc_id, n_features, weight, score, rank (null where it isn't drawn), n_words."""
    spark = docs.sparkSession
    scored = weights(docs, target, id_col=id_col, text_col=text_col, target_col=target_col, buckets=buckets).withColumn("score", (F.col("weight") + noise("doc_id", seed)).cast("long"))
    # Rows that tie in score and id are told apart by their place, so that repeated rows can't fill one range.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("place")]
    ranged = scored.filter(F.col("n_words") >= least).select("block", "place", "doc_id", "score").repartitionByRange(partitions(spark), *order)
    lined, lined_path = stored(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    before, drawn = {}, 0
    for r in lined.groupBy("range").count().orderBy("range").collect():  # a row for each partition
        before[r["range"]] = drawn
        drawn += r["count"]
    drawn = drawn * percent // 100
    offsets = spark.createDataFrame([(k, n) for k, n in before.items() if n < drawn], "range int, before long")
    ranked = lined.join(F.broadcast(offsets), "range").withColumn("rank", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))).cast("long")).filter(F.col("rank") <= drawn).select("block", "place", "rank")
    out, _ = stored(scored.join(ranked, ["block", "place"], "left").select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank", "n_words"), "resampled")
    forget(spark, lined_path)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract, written out; crc32 by its table.
SQL = r"""
with recursive crc(k, c) as (select i, i::bigint from range(256) r(i)),
     bits as (select k, list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c from crc),
     tab as (select list(c order by k) as t from bits),
     texts as (select 's' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
               union all select 't', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
     w as (select side, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
     f as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
     n as (select side, id, f, count(*) as n from f group by all),
     d as (select distinct f from n),
     h as (select f, list_concat([4294967295::bigint], list_transform(range(1, len(hex(encode(f))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint)) as b from d),
     b as (select f, xor(list_reduce(b, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 10000 as bucket from h, tab),
     p as (select side, id, bucket, n from n join b using (f)),
     tot as (select bucket, coalesce(sum(n) filter (side = 's'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from p group by bucket),
     al as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from tot),
     g as (select bucket, floor(1000 * ln((tot.t + 1)::double * (al.s + 10000)::double / ((tot.s + 1)::double * (al.t + 10000)::double)))::bigint as gain from tot, al),
     x as (select id as doc_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from p join g using (bucket) where side = 's' group by id),
     y as (select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight from w left join x on x.doc_id = w.id where side = 's'),
     z as (select *, (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint)::bigint as score from y),
     r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from z where n_words >= 20)
select doc_id, n_features, weight, score, n_words, case when rank <= 25 * n // 100 then rank end as rank from z left join r using (doc_id)
"""
