"""A stored full-text index that grows by segments, and exact best hits with bounds by block.

Chunks lie in blocks of BLOCK. A posting row is a term in a block: its entries (a place in the block, the chunk, its length,
the term's count and positions), and what can be known of them without reading them: how many, the largest count, the
shortest chunk, and which places as four 64-bit words. A block's rows lie in one file, sorted by term in runs of some RUN
words, so that a reader skips pages. They are made where the chunks lie: the blocks of a part follow each other in one task,
so neither words nor entries are shuffled or sorted by Spark. A vocabulary
(term, df, n_blocks) lies beside them, sorted and front-coded (Parquet's DELTA_BYTE_ARRAY).

Each addition writes a segment of its own; as soon as FAN segments are of one tier (sizes within a factor of FAN), they are
merged into one. So a chunk's postings are written again once for each tier, which is a logarithm of the number of chunks.
A merge copies full blocks as they are and puts the entries of partly filled ones together anew. A manifest, replaced whole,
says which segments count, so readers see either all of an addition or a merge or nothing of it. One writer at a time.

A search of single words (prefixes) reads the blocks' bounds first: the documents of each word are counted from the places
alone, and what a block's best chunk can score at most follows from the largest counts and the shortest length. The blocks
of the highest bounds are scored; then only those whose bound comes up to the worst of the hits so far. The hits are those
of scoring everything. Phrases of several terms need positions and are scored everywhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.operators import fulltext

BLOCK = 256
FAN = 4
#: Blocks that are scored first, and blocks that a filter names one by one.
FIRST, NAMED = 16, 1000
#: Up to so many blocks all are scored at once: another pass over them costs more than it saves. Hits are the same.
SMALL = 2048
#: Words whose posting rows are made at once, whole blocks, and rows that are handed on at once.
RUN, ROWS = 1_000_000, 20_000
#: Numbers of blocks of one addition.
SPAN = 1 << 40

ENTRY = "struct<place:int,chunk_id:string,message_id:{kind},chunk_index:int,len:int,tf:bigint,positions:array<int>>"
BITS = ("b0", "b1", "b2", "b3")
MANIFEST = "segment string, seq bigint, n_chunks bigint, sum_len bigint, n_blocks bigint, covers bigint"


def _posting(kind: str) -> str:
    return f"block bigint, term string, n int, max_tf bigint, min_len int, {', '.join(f'{b} bigint' for b in BITS)}, entries array<{ENTRY.format(kind=kind)}>"


def _rows(entries: DataFrame) -> DataFrame:
    """Posting rows from term, block and entry (a struct as ENTRY), a row for each chunk of a term."""
    bits = [F.bit_or(F.when(F.floor(F.col("entry.place") / 64) == i, F.expr("shiftleft(1L, entry.place % 64)")).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(BITS)]
    return entries.groupBy("block", "term").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("entry.tf").alias("max_tf"), F.min("entry.len").alias("min_len"), *bits, F.array_sort(F.collect_list("entry")).alias("entries"))


def _laid_out(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("term", "block")


def _posted(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Posting rows, sorted by term and block, of whole blocks: block, place, chunk_id, message_id, chunk_index, words in order."""
    t = t.combine_chunks()
    words = t["words"].combine_chunks() if t["words"].num_chunks != 1 else t["words"].chunk(0)
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not size.sum():
        return
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    found = pc.list_flatten(words).dictionary_encode()
    by_term = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    blocks, block = np.unique(t["block"].to_numpy(), return_inverse=True)
    key = rank[found.indices.to_numpy()] * len(blocks) + block[row]
    order = np.argsort(key, kind="stable")  # within a term and block: by place, then position
    key, row, pos = key[order], row[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))  # of an entry
    tf, key, row = np.diff(np.append(first, len(row))), key[first], row[first]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # of a posting row
    length, place = size[row], t["place"].to_numpy()[row]
    bit = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
    bits = [np.bitwise_or.reduceat(np.where(place // 64 == i, bit, np.uint64(0)), head).view(np.int64) for i in range(len(BITS))]
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), pa.array(pos, pa.int32()))
    own = pa.array(row)
    entry = {"place": pa.array(place, pa.int32()), **{c: t[c].combine_chunks().take(own) for c in ("chunk_id", "message_id", "chunk_index")}, "len": pa.array(length, pa.int32()), "tf": pa.array(tf, pa.int64()), "positions": positions}
    entry = pa.StructArray.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in entry.values()], names=list(entry))
    out = {
        "block": pa.array(blocks[key[head] % len(blocks)], pa.int64()), "term": found.dictionary.take(pa.array(by_term[key[head] // len(blocks)])), "n": pa.array(np.diff(np.append(head, len(key))), pa.int32()),
        "max_tf": pa.array(np.maximum.reduceat(tf, head), pa.int64()), "min_len": pa.array(np.minimum.reduceat(length, head), pa.int32()), **{b: pa.array(x, pa.int64()) for b, x in zip(BITS, bits, strict=True)},
        "entries": pa.ListArray.from_arrays(pa.array(np.append(head, len(key)), pa.int32()), entry),
    }
    yield from pa.Table.from_pydict(out).to_batches(max_chunksize=ROWS)


def _by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_posted of runs of whole blocks, RUN words or one block at least; a block goes on from one batch to the next."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("words").flatten())
        if n >= RUN:
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t["block"].to_numpy(), t["block"][-1].as_py()))
            if cut:
                yield from _posted(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                n = sum(len(x.column("words").flatten()) for x in held)
    if held:
        yield from _posted(pa.Table.from_batches(held))


def blocked(words: DataFrame) -> DataFrame:
    """Posting rows from block, place, chunk_id, message_id, chunk_index, words (its terms in order); a block lies in one part, and blocks and places ascend there."""
    kind = words.schema["message_id"].dataType.simpleString()
    return words.select("block", "place", "chunk_id", "message_id", "chunk_index", "words").mapInArrow(_by_runs, _posting(kind))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks (read twice, in the same parts each time: a written table) with block and place; the blocks of one part follow each other."""
    rows = chunks.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_m", 33), "_row": F.col("_m").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")).orderBy("_part").collect()  # a row for each part
    first, at = [], 0
    for r in counts:
        first.append((r["_part"], at))
        at += r["n"]
    starts = chunks.sparkSession.createDataFrame(first, "_part bigint, _first bigint")
    return rows.join(F.broadcast(starts), "_part").withColumns({"block": F.col("_first") + F.floor(F.col("_row") / BLOCK), "place": (F.col("_row") % BLOCK).cast("int")}).drop("_m", "_part", "_row", "_first")


def entries(postings: DataFrame) -> DataFrame:
    """The columns that fulltext.search reads, a row for each chunk of a term."""
    return postings.select("term", F.explode("entries").alias("e")).select("term", "e.chunk_id", "e.message_id", "e.chunk_index", "e.len", "e.tf", "e.positions")


@dataclass(frozen=True)
class Found:
    """The hits (at most the pool), and how many blocks held a word and were scored for it."""

    rows: list
    blocks: int
    scored: int


def best(postings: DataFrame, words: list[str], pool: int, n_docs: int, avg_len: float, *, within: DataFrame | None = None, first: int = FIRST, small: int = SMALL, n_blocks: int | None = None) -> Found:
    """chunk_id, message_id, chunk_index, bm25 of the best `pool` chunks for the OR of prefixes, in order.

    Expressions are SQL text: a search of a small index takes less time than the calls that would build them as Columns."""
    each = range(len(words))
    some = postings.withColumns({f"h{i}": F.col("term").startswith(w) for i, w in enumerate(words)}).filter(" or ".join(f"h{i}" for i in each))
    bounds = [f"{f}(if(h{i}, {c}, null)) as {n}{i}" for i in each for f, c, n in (("sum", "max_tf", "m"), ("min", "min_len", "l"))]
    places = [f"bit_or(if(h{i}, {b}, null)) as {b}_{i}" for i in each for b in BITS]
    count = [f"coalesce({' + '.join(f'bit_count({b}_{i})' for b in BITS)}, 0) as n{i}" for i in each]
    blocks = some.groupBy("block").agg(*map(F.expr, bounds + places)).selectExpr("block", *[f"{c}{i}" for i in each for c in "ml"], *count)
    few = n_blocks is not None and n_blocks <= small
    blocks = blocks if few else blocks.persist()
    try:
        sums = blocks.selectExpr("count(1) as blocks", *[f"coalesce(sum(n{i}), 0L) as n{i}" for i in each]).first()
        df = [sums[f"n{i}"] for i in each]
        if not any(df):
            return Found([], 0, 0)
        part = lambda i, tf, length: fulltext.bm25(tf, length, fulltext.number(df[i]), fulltext.number(n_docs), fulltext.number(avg_len))

        def scored(rows: DataFrame) -> list:
            # The chunk's columns are keys, not values: sums alone are hashed, where a string beside them would make Spark sort.
            flat = rows.selectExpr("block", *[f"h{i}" for i in each], "inline(entries)")
            wide = flat.groupBy("block", *fulltext.CHUNK).agg(*[F.expr(f"sum(if(h{i}, tf, null)) as tf{i}") for i in each])
            total = " + ".join(f"coalesce({part(i, f'tf{i}', 'len')}, 0D)" for i in each)
            found = wide.selectExpr("chunk_id", "message_id", "chunk_index", f"-({total}) as bm25")
            if within is not None:
                found = found.join(within, "message_id", "left_semi").select(*found.columns)
            return fulltext.best(found, pool).collect()  # at most `pool` rows

        if few:
            return Found(scored(some), sums["blocks"], sums["blocks"])
        most = " + ".join(f"if(n{i} > 0, {part(i, f'm{i}', f'l{i}')}, 0D)" for i in each)
        bounded = blocks.selectExpr("block", f"{most} as most").orderBy(F.desc("most"), "block")
        at = bounded.limit(first + NAMED + 1).collect()
        top = [r["block"] for r in at[:first]]
        hits = scored(some.filter(F.col("block").isin(top)))
        # Rounding may differ in the last digit between a bound and the score that it bounds.
        least = -hits[-1]["bm25"] * (1 - 1e-12) if len(hits) == pool else 0.0
        left = [r["block"] for r in at[first:] if r["most"] >= least]
        if len(left) <= NAMED:
            more = scored(some.filter(F.col("block").isin(left))) if left else []
            n_scored = len(top) + len(left)
        else:
            open_blocks = bounded.filter((F.col("most") >= least) & ~F.col("block").isin(top)).select("block")
            more = scored(some.join(open_blocks, "block", "left_semi"))
            n_scored = len(top) + open_blocks.count()
        ordered = sorted([*hits, *more], key=lambda r: (r["bm25"], r["message_id"], r["chunk_index"]))[:pool]
        return Found(ordered, sums["blocks"], n_scored)
    finally:
        if not few:
            blocks.unpersist()


def by_block(postings: DataFrame) -> DataFrame:
    """Postings dealt by block and sorted by term, to be kept in memory: what is grouped by block needs no shuffle, and batches of other terms are skipped by their least and largest term."""
    return postings.repartition("block").sortWithinPartitions("term")


def tier(n_chunks: int) -> int:
    return max(0, math.floor(math.log(max(n_chunks, 1) / BLOCK, FAN)) + 1)


class Index:
    """Segments below `path`. covers: the version of the chunks that the index was brought up to."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column], *, stems: bool = True, kind: str = "string"):
        self.spark, self.path, self.tokens, self.stems, self.kind = spark, path.rstrip("/"), tokens, stems, kind
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        #: Posting rows written so far, by this object.
        self.written = 0
        self._known: tuple[int, list] = (0, [])

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    # -- what is there -----------------------------------------------------------------------------------------------

    def _manifests(self) -> list[int]:
        root = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(root):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(root) if self._fs.exists(self._hadoop(f"{f.getPath()}/_SUCCESS")))

    def segments(self) -> list:
        """Rows of the last manifest, one for each segment; their number is a logarithm of the chunks'. A manifest never changes, so each is read once."""
        last = max(self._manifests(), default=0)
        if last != self._known[0]:
            self._known = last, self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/m{last}").orderBy("seq").collect() if last else []
        return list(self._known[1])

    @property
    def covers(self) -> int:
        return max((s["covers"] for s in self.segments()), default=0)

    def _read(self, part: str, names: list[str], kind: str) -> DataFrame:
        folders = [f"{self.path}/segments/{n}/{part}" for n in names]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    @property
    def _posting(self) -> str:
        return _posting(self.kind)

    def postings(self, names: list[str] | None = None) -> DataFrame:
        return self._read("postings", [s["segment"] for s in self.segments()] if names is None else names, self._posting)

    def vocabulary(self, names: list[str] | None = None) -> DataFrame:
        """term, df, n_blocks, over all segments."""
        rows = self._read("vocabulary", [s["segment"] for s in self.segments()] if names is None else names, "term string, df bigint, n_blocks bigint")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_blocks").alias("n_blocks"))

    def statistics(self) -> tuple[int, float]:
        """Chunks, and their mean length."""
        rows = self.segments()
        n = sum(s["n_chunks"] for s in rows)
        return n, sum(s["sum_len"] for s in rows) / n if n else 0.0

    # -- changes -----------------------------------------------------------------------------------------------------

    def _publish(self, rows: list[tuple]) -> None:
        numbers = self._manifests()
        number = numbers[-1] + 1 if numbers else 1
        before = {s["segment"] for s in self.segments()}
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/m{number}")
        for n in numbers[:-1]:
            self._fs.delete(self._hadoop(f"{self.path}/manifest/m{n}"), True)
        kept = before | {r[0] for r in rows}  # what the manifest before names stays for readers that have begun
        for f in self._fs.listStatus(self._hadoop(f"{self.path}/segments")):
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)

    def _write(self, postings: DataFrame, sizes: DataFrame, folder: str) -> None:
        # Entries name their chunk again and again: a dictionary that holds a row group's chunks, and zstd.
        postings.write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", str(8 << 20)).parquet(f"{folder}/postings")
        sizes.write.mode("overwrite").parquet(f"{folder}/blocks")
        rows = self.spark.read.schema(self._posting).parquet(f"{folder}/postings").select("term", "n")
        words = rows.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("n_blocks")).repartitionByRange("term").sortWithinPartitions("term")
        words.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(f"{folder}/vocabulary")
        self.written += rows.count()

    def _segment(self, chunks: DataFrame, seq: int, covers: int) -> tuple:
        """Writes a segment of chunk_id, message_id, chunk_index, text; its row of the manifest."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        chunks.select("chunk_id", "message_id", "chunk_index", self.tokens(F.col("text")).alias("words")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/words")
        words = numbered(self.spark.read.parquet(f"{folder}/words")).withColumn("block", F.col("block") + seq * SPAN)
        self._write(blocked(words), words.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("words")).alias("len")), folder)
        sizes = self.spark.read.schema("block bigint, size bigint, len bigint").parquet(f"{folder}/blocks")
        sums = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"), F.count(F.lit(1)).alias("blocks")).first()
        self._fs.delete(self._hadoop(f"{folder}/words"), True)
        return name, seq, sums["n"], sums["len"], sums["blocks"], covers

    def cover(self, covers: int) -> None:
        """The same chunks have another version now."""
        self._publish([(*tuple(s)[:-1], covers) for s in self.segments()])

    def rebuild(self, chunks: DataFrame, covers: int) -> None:
        """One segment of all chunks."""
        seq = max((s["seq"] for s in self.segments()), default=0) + 1
        self._publish([self._segment(chunks, seq, covers)])

    def add(self, chunks: DataFrame, covers: int) -> None:
        """A segment of new chunks; then tiers that are full are merged."""
        rows = [tuple(s) for s in self.segments()]
        rows.append(self._segment(chunks, max((r[1] for r in rows), default=0) + 1, covers))
        self._publish(rows)
        while True:
            by: dict[int, list[tuple]] = {}
            for r in rows:
                by.setdefault(tier(r[2]), []).append(r)
            full = next((t for t in sorted(by) if len(by[t]) >= FAN), None)
            if full is None:
                return
            rows = [r for r in rows if r not in by[full]] + [self._merged(by[full], max(r[1] for r in rows) + 1)]
            self._publish(rows)

    def _merged(self, old: list[tuple], seq: int) -> tuple:
        name, names = uuid.uuid4().hex, [r[0] for r in old]
        sizes = self._read("blocks", names, "block bigint, size bigint")
        rows = self.postings(names)
        # Full blocks keep their numbers. Partly filled ones, at most one for each part of a segment, are laid end to end.
        part = sizes.filter(F.col("size") < BLOCK).withColumn("begin", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        flat = rows.join(F.broadcast(part), "block").select("term", "begin", F.explode("entries").alias("e"))
        at = F.col("begin") + F.col("e.place")
        again = _rows(flat.select((F.floor(at / BLOCK) + seq * SPAN).alias("block"), "term", F.struct((at % BLOCK).cast("int").alias("place"), *[F.col(f"e.{c}") for c in ("chunk_id", "message_id", "chunk_index", "len", "tf", "positions")]).alias("entry")))
        whole = rows.join(F.broadcast(part.select("block")), "block", "left_anti").select(*again.columns)
        ends = part.select(F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK))).alias("k"), "begin", "size")
        filled = ends.groupBy((F.col("k") + seq * SPAN).alias("block")).agg(F.sum(F.least(F.col("begin") + F.col("size"), (F.col("k") + 1) * BLOCK) - F.greatest(F.col("begin"), F.col("k") * BLOCK)).alias("size"))
        new_sizes = sizes.filter(F.col("size") >= BLOCK).unionByName(filled)
        self._write(whole.unionByName(_laid_out(again)), new_sizes, f"{self.path}/segments/{name}")
        blocks = self.spark.read.schema("block bigint, size bigint").parquet(f"{self.path}/segments/{name}/blocks").count()
        return name, seq, sum(r[2] for r in old), sum(r[3] for r in old), blocks, max(r[5] for r in old)

    # -- search ------------------------------------------------------------------------------------------------------

    def search(self, query: str, pool: int, *, within: DataFrame | None = None, postings: DataFrame | None = None, small: int = SMALL) -> Found:
        """The best `pool` chunks, as fulltext.search gives them. postings: those of this index, if they are kept (by_block, best)."""
        rows = self.postings() if postings is None else postings
        wanted = fulltext.phrases(query, self.stems)
        known = self.segments()
        n_docs = sum(x["n_chunks"] for x in known)
        if not wanted or not n_docs:
            return Found([], 0, 0)
        avg_len = sum(x["sum_len"] for x in known) / n_docs
        if all(len(t) == 1 for t in wanted):
            return best(rows, [t[0] for t in wanted], pool, n_docs, avg_len, within=within, small=small, n_blocks=sum(x["n_blocks"] for x in known))
        some = rows.filter(reduce(or_, [F.col("term").startswith(t) if k + 1 == len(terms) else F.col("term") == t for terms in wanted for k, t in enumerate(terms)]))
        found = fulltext.search(entries(some), None, query, pool, stems=self.stems, stats=self.corpus(), within=within).collect()  # at most `pool` rows
        return Found(found, len(found), len(found))

    def corpus(self) -> DataFrame:
        n, mean = self.statistics()
        return self.spark.createDataFrame([(n, float(mean))], "n_docs bigint, avg_len double")

    def search_batch(self, queries: list[tuple], pool: int) -> DataFrame:
        return fulltext.search_batch(entries(self.postings()), self.corpus(), queries, pool, stems=self.stems)
