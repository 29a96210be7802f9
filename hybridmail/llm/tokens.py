"""Token ids as Parquet list columns, laid out for selective reads.

Documents are dealt by ranges of their id and sorted within, so file i holds smaller ids than file i + 1 and each row
group and page covers a narrow range of ids; Parquet's column and offset indexes (written by default) then let a reader
skip to the pages of the ids it wants. The id and count columns are delta-encoded (format version 2), the token column
is dictionary-encoded where the ids of a row group fit a dictionary and delta-encoded beyond, row groups and pages are of
the sizes given below. A count or an id is read without touching the tokens.

Tokenizing: the pre-tokenizer of the byte-level vocabulary never joins text across a single space or line end, nor a word
of letters with the mark after it, so texts are cut there, all at once, and each distinct piece (found by a 64-bit hash,
then compared byte by byte) is encoded by the library once for a batch and remembered (the first CACHE pieces). A text with runs of white space, white
space at an end, or unprintable characters is encoded whole.

Added tokens of the vocabulary ('<|endoftext|>') in a text: with added=True, as the queries have it, they get their own
ids, the library's default, and a text that holds one is encoded whole. Without it, they are ordinary text.

Null texts count as empty: an empty document is its end id alone. Null ids come first. Repeated rows and equal ids are
written each for itself; rows of an equal id follow each other in the order of their tokens. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import column, eights, integer_id, same_stretches, scratch, ship, slices, small_batches
from hybridmail.llm.substrings import hash_stretches

END = 2
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: Pieces remembered by one Python worker, of about 40 bytes each.
CACHE = 1_500_000
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}

def can_be_cut(text: str) -> bool:
    """Whether its white space is single spaces and line ends inside the text; no other white space counts as printable."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")) and text.replace("\n", "").isprintable() if text else True


#: Stands before each text; a text that can be cut doesn't hold it.
FIRST = b"\x00"
_BETWEEN = b"\x01"
_ENDS = np.isin(np.arange(256), np.frombuffer(b"\x00\n", dtype=np.uint8))
_BEFORE = _ENDS | (np.arange(256) == 32)
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))
_LETTERS = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8))


def piece_starts(line: np.ndarray) -> np.ndarray:
    """Where texts on one line, FIRST before each, are cut: before spaces, around line ends, and before one mark that ends a word of letters. The pre-tokenizer parts all these."""
    here = _BEFORE[line]
    cut = here.copy()
    cut[1:] |= _ENDS[line[:-1]]
    cut[1:-1] |= _MARKS[line[1:-1]] & _LETTERS[line[:-2]] & here[2:]
    if len(line) > 1:
        cut[-1] |= _MARKS[line[-1]] & _LETTERS[line[-2]]
    return np.flatnonzero(cut)


class Pieces:
    """Ids of known pieces, in arrays: ascending hashes, the pieces' bytes, and where the ids of each lie in one buffer."""

    def __init__(self, tokenizer, added: tuple[str, ...] = ()):
        self.tokenizer, self.most, self.added = tokenizer, CACHE, added
        none = np.zeros(0, dtype=np.int64)
        self.hashes, self.start, self.size, self.at, self.length = np.zeros(0, dtype=np.uint64), none, none.astype(np.int32), none, none.astype(np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.bytes, self.filled = np.zeros(1 << 18, dtype=np.uint8), 0

    def look_up(self, own: np.ndarray, data: bytes, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """own: ascending hashes of pieces, which lie in data. Where in self.ids each begins, and how many ids it has; good until the next call. A piece is known by its hash and then by its bytes."""
        place = np.searchsorted(self.hashes, own)
        hit, start, size = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int32)
        taken = hit
        if len(self.hashes):
            near = np.minimum(place, len(self.hashes) - 1)
            taken = self.hashes[near] == own
            hit = taken & (self.length[near] == length)
            some = near[hit]
            hit[hit] = same_stretches(eights(self.bytes), self.at[some], eights(np.frombuffer(data, dtype=np.uint8)), at[hit], length[hit])
            start, size = np.where(hit, self.start[near], 0), np.where(hit, self.size[near], 0)
        new = np.flatnonzero(~hit)
        if len(new):
            pieces = [data[a : a + n] for a, n in zip(at[new].tolist(), length[new].tolist(), strict=True)]
            texts = _BETWEEN.join(x if x != FIRST else b"" for x in pieces).decode().split(_BETWEEN.decode())
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            until = self.used + int(sizes.sum())
            if until > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(max(until - len(self.ids), len(self.ids) // 2), dtype="<u4")))
            self.ids[self.used : until] = np.fromiter(chain.from_iterable(found), dtype="<u4", count=until - self.used)
            start[new], size[new] = self.used + np.cumsum(sizes) - sizes, sizes
            keep = ~taken[new]  # of two pieces of one hash the first is remembered
            if len(self.hashes) < self.most and keep.all():
                line = b"".join(pieces)
                if self.filled + len(line) + 8 > len(self.bytes):
                    self.bytes = np.concatenate((self.bytes, np.zeros(max(len(line) + 8, len(self.bytes) // 2), dtype=np.uint8)))
                self.bytes[self.filled : self.filled + len(line)] = np.frombuffer(line, dtype=np.uint8)
                own_at = self.filled + np.cumsum(length[new]) - length[new]
                self.hashes, self.start, self.size, self.at, self.length = (np.insert(x, place[new], y) for x, y in ((self.hashes, own[new]), (self.start, start[new]), (self.size, size[new]), (self.at, own_at), (self.length, length[new])))
                self.used, self.filled = until, self.filled + len(line)
        return start, size


#: One for each vocabulary, with and without its added tokens, in a Python worker, which lives longer than a task.
_KNOWN: dict[tuple[str, bool], Pieces] = {}


def _pieces(vocabulary: str, added: bool = False) -> Pieces:
    if (vocabulary, added) not in _KNOWN:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        if not added:
            tokenizer.encode_special_tokens = True
        _KNOWN[vocabulary, added] = Pieces(tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()) if added else ())
    return _KNOWN[vocabulary, added]


def _whole(texts: list[str], known: Pieces, end: int) -> list[np.ndarray]:
    return [np.array([*e.ids, end], dtype=np.uint32) for e in known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _cut_and_encoded(texts: list[str], known: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that can be cut, with the end id after each, and the number of ids of each. Equal pieces of all texts are looked up once."""
    data = b"".join([*(FIRST + t.encode() for t in texts), b"\x01" * 8])
    line = np.frombuffer(data, dtype=np.uint8)
    start = piece_starts(line[:-8])
    size = np.diff(np.append(start, len(data) - 8))
    own, first, inverse = np.unique(hash_stretches(data, start, size), return_index=True, return_inverse=True)
    place = first[inverse]
    again = np.flatnonzero(place != np.arange(len(place)))
    view, place = eights(line), place[again]
    if (size[again] != size[place]).any() or not same_stretches(view, start[again], view, start[place], size[again]).all():
        parts = _whole(texts, known, end)  # two pieces of one hash
        return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    places, sizes = known.look_up(own, data, start[first], size[first])
    each = sizes[inverse].astype(np.int64)
    until = np.cumsum(each)
    ids = known.ids[np.repeat(places[inverse] - (until - each), each) + np.arange(int(until[-1]))]
    begins = np.flatnonzero(line[start] == 0)
    counts = np.add.reduceat(each, begins)
    return np.insert(ids, np.cumsum(counts), end), counts + 1


def encoded(texts: list[str], known: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts on one line, and how many each has."""
    whole = [i for i, t in enumerate(texts) if not can_be_cut(t) or any(a in t for a in known.added)]
    if not whole:
        return _cut_and_encoded(texts, known, end)
    rest = sorted(set(range(len(texts))) - set(whole))
    parts: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
    for i, x in zip(whole, _whole([texts[i] for i in whole], known, end), strict=True):
        parts[i] = x
    if rest:
        ids, counts = _cut_and_encoded([texts[i] for i in rest], known, end)
        for i, x in zip(rest, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            parts[i] = x
    return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


def encoder(vocabulary: str, end: int, cache: int = CACHE, added: bool = False):
    """A mapInArrow function from (doc_id, text) to (doc_id, n_tokens, ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(vocabulary, added)
        known.most = cache
        gc.disable()  # nothing here makes cycles, and the collector would go through all that is remembered
        for batch in slices(batches, "text", 3 << 20):
            ids, counts = encoded([x or "" for x in batch.column(1).to_pylist()], known, end)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))], names=["doc_id", "n_tokens", "ids"])

    return encode


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, files: int | None = None, cache: int = CACHE, added: bool = False) -> None:
    """Writes doc_id, n_tokens and ids (int32; an id is below 2**31) under path, in ascending order of id over the files."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(integer_id(df, id_col).alias("doc_id"), column(text_col).alias("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ties of the id have a defined order by their text; a hash of it spreads an id of very many rows over several files.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    dealt = docs.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    with small_batches(spark):
        dealt.mapInArrow(encoder(vocabulary, end, cache, added), SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str, *, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of the ids low to high (both included); pages outside aren't read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens in each file, from its count column alone."""
    for batch in batches:
        for part, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = FileSystem.from_uri(uri)
            with fs.open_input_file(path) as file:
                counts = pq.read_table(file, columns=["n_tokens"]).column(0)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "tokens": pa.array([int(counts.to_numpy().sum())], pa.int64())})


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each file with their place in it."""
    for batch in batches:
        for part, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = FileSystem.from_uri(uri)
            before = 0
            with fs.open_input_file(path) as file:
                for rows in pq.ParquetFile(file).iter_batches(2000, columns=["doc_id", "ids"]):
                    ids = rows.column(1)
                    ends = ids.offsets.to_numpy().astype(np.int64)
                    view = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")).cast("B")
                    crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), dtype=np.int64, count=len(ids))
                    own = before + ends[:-1] - ends[0]
                    before += int(ends[-1] - ends[0])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), rows.column(0), pa.array(own), pa.array(np.diff(ends)), pa.array(crc)], names=["part", "doc_id", "own", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32. Starts come from places within each file and sums over the files."""
    ship(spark)
    uris = sorted(spark.read.schema(SCHEMA).parquet(path).inputFiles(), key=lambda x: int(re.search(r"part-(\d+)", x)[1]))  # parts are numbered in the order of the ids
    files = spark.createDataFrame([(i, unquote(x)) for i, x in enumerate(uris)], "part long, uri string").repartition(max(1, len(uris)), "part")
    sums = files.mapInArrow(_sums, "part long, tokens long")
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return files.mapInArrow(_crc, "part long, doc_id long, own long, n_tokens long, ids_crc32 long").join(sums, "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(df: DataFrame, name: str = "tokens", **options) -> DataFrame:
    path = scratch(df.sparkSession, name)
    write(df, path, **options)
    return digest(df.sparkSession, path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=True)
