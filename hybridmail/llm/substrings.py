"""Substring dedup by recompression: removes long passages that an earlier document already has.

A window is WINDOW consecutive words of one document. A word is removed if some window that covers it also starts in a
document with a smaller id.

1. Names within a window. Words are named by a 64-bit hash. A first round names maximal runs of an equal word; each
   further round splits the symbols in two halves by a hash bit and names every adjacent (left, right) pair. A name is a
   hash of what it stands for, so that all documents give equal names to equal content where the text lies. With each
   symbol goes the stretch of words that its existence depends on (half of the symbols look at one neighbour a round).
   Each window chooses the symbol of least hash among those that depend on words of the window alone: equal windows choose
   equal symbols at equal places; a window without one stands for itself. Neighbouring windows of one choice make a row:
   the symbol, and a fingerprint of all words that these windows span.
2. The first global round drops the rows whose symbol occurs in one document only: most of the corpus.
3. Further global rounds (LEVELS of them, each a Spark step over all rows that are left) name runs of rows: symbols that
   follow each other are split in halves by a hash bit, all distinct (left, right) pairs are grouped, and where a pair also
   occurs in a smaller document the two rows become one row of the pair's name. So a long repeat comes down to few symbols
   of a high level; the smallest document keeps its lower ones, which still smaller documents may share.
4. Verification. The words of each shared row, and of the row that it repeats, are read again and compared by a 128-bit
   BLAKE2 digest of their bytes. Where a symbol is shared but the words around differ (the repeat ends near there), the
   windows of the row are digested and grouped one by one. No name counts that the words don't bear out: a clash of names
   can only make work, never a wrong removal. Names have 128 bits (a symbol and a fingerprint, or two hashes of a pair), so
   that a clash isn't to be expected among the stretches of any corpus; should words contradict a name all the same, the
   rounds are run again under another salt.

The result is that of comparing all windows. Minima are combined before they are shuffled. Rows look up what is known of
their key in two ways: the HOT most frequent keys are broadcast (that many rows, whatever the input), and the rows that
they answer are dealt at random, so that no key brings more than one part in HOT of the rows into one task.

Null texts have no words. Texts of fewer than WINDOW words lose nothing, nor do documents with a null id (they have no
order), whose windows count for nobody. Repeated rows of one id are treated alike and aren't compared with each other. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import column, forget, integer_id, ship, slices, stored, table, texts_of

WINDOW = 50
ROUNDS = 5
#: Global rounds over the symbols that windows chose.
LEVELS = 3
#: Keys that are broadcast with what is known of them: the most frequent ones.
HOT = 1000
#: Bits of a choice that hold the place (the least hash wins, then the first place); the same for all batches.
_PLACE = 26
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The six bytes between words, and a fixed random number for each byte.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
_BYTE = mix(np.arange(256, dtype=_U), 11)
#: Longer stretches are hashed one by one.
_LONG = 64


def hash_stretches(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, all at once, a byte of each at a time."""
    line = np.frombuffer(data, dtype=np.uint8)
    order = np.argsort(-size, kind="stable")
    at, left = start[order], -size[order]
    h = np.zeros(len(start), dtype=_U)
    long = int(np.searchsorted(left, -_LONG, "left"))
    for k in range(min(_LONG, int(-left[long]) if long < len(left) else 0)):
        m = int(np.searchsorted(left, -k, "left"))
        h[long:m] = h[long:m] * _U(_B1) + _BYTE[line[at[long:m] + k]]
    for i in range(long):
        h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] - left[i]])
    out = np.empty_like(h)
    out[order] = mix(h ^ (-left).astype(_U), 12)
    return out


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their sizes in bytes."""
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, dtype=np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts on one line, and where each text begins (one more entry than texts)."""
    data = b"\n".join([*texts, b""])
    start, size = word_edges(data)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
    return hash_stretches(data, start, size), np.searchsorted(start, begins)


class Prints:
    """Fingerprints of stretches of a line of hashes, from prefix sums modulo 2**64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, line: np.ndarray, base: int, salt: int):
        n = len(line)
        up, down = self.powers.get(base, (np.ones(1, _U), np.ones(1, _U)))
        if len(up) <= n:
            size = 1 << (n + 1).bit_length()
            inverse = pow(base, -1, 2**64)
            up, down = (np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, dtype=_U))), dtype=_U) for b in (base, inverse))
            if size <= 1 << 22:
                self.powers[base] = (up, down)
        self.down = down
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(line, salt) * up[:n], dtype=_U)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(_U), 77)


def recompress(line: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols of the last round: name, first and last word (exclusive), and the words from dl to dr that each depends on."""
    n = len(line)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds[:-1]] = True
    first = first[:n]
    begin = np.ones(n, dtype=bool)
    begin[1:] = (line[1:] != line[:-1]) | first[1:]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    name = line[start]
    run = end - start
    name = np.where(run > 1, mix(name ^ run.astype(_U), 3), name)
    dl, dr, first = start - 1, end + 1, first[start]
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        right = (mix(name, 100 + r) >> _U(63)).astype(bool)
        pair = np.zeros(m, dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        second = np.zeros(m, dtype=bool)
        second[1:] = pair[:-1]
        last = np.append(first[1:], True)
        following = np.append(np.arange(1, m), m - 1)
        named = np.where(pair, mix(mix(name, 200 + r) ^ name[following], 300 + r), name)
        new_end = np.where(pair, end[following], end)
        new_dl = dl.copy()
        alone = right & ~second & ~first  # whether it was taken by the symbol before it takes a look at that one
        at = np.flatnonzero(alone)
        new_dl[at] = dl[at - 1]
        new_dr = np.where(pair | (~right & ~last), dr[following], dr)
        keep = ~second
        name, start, end, dl, dr, first = named[keep], start[keep], new_end[keep], new_dl[keep], new_dr[keep], first[keep]
    return name, start, end, dl, dr


def rows_of(line: np.ndarray, bounds: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """For each run of windows with the same choice: symbol, fingerprint, text, first and last window (as word of the text)."""
    none = np.zeros(0, dtype=np.int64)
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return none.astype(_U), none.astype(_U), none, none, none
    text = np.repeat(np.arange(len(counts)), counts)
    p = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[text]
    name, _, _, dl, dr = recompress(line, bounds, rounds)
    low, high = np.searchsorted(dl, p, "left"), np.searchsorted(dr, p + window, "right")
    size = high - low
    has = size > 0
    key = (mix(name, 9) >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(name), dtype=_U)
    tables = [key]
    while 2 << (len(tables) - 1) <= window and len(tables[-1]) > 1 << (len(tables) - 1):
        t, k = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-k], t[k:]))
    choice = -1 - p  # windows without a symbol choose themselves
    level = np.zeros(total, dtype=np.int64)
    level[has] = np.frexp(size[has].astype(np.float64))[1] - 1
    for k, t in enumerate(tables):
        at = np.flatnonzero(has & (level == k))
        if len(at):
            best = np.minimum(t[low[at]], t[high[at] - (1 << k)])
            choice[at] = (best & _U((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (choice[1:] != choice[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    until = np.append(at[1:], total) - 1
    p0, p1, chosen, text = p[at], p[until], choice[at], text[at]
    whole = Prints(line, _B1, 1).of(p0, p1 + window)
    # All words that the symbol depends on name it; they are in each of its windows, and rarely occur twice by chance.
    own, i = chosen < 0, np.maximum(chosen, 0)
    symbol = Prints(line, _B2, 2).of(np.where(own, p0, dl[i] if len(dl) else 0), np.where(own, p0 + window, dr[i] if len(dr) else 0))
    return symbol, whole, text, p0 - bounds[text], p1 - bounds[text]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _parse(window: int, rounds: int, salt: int, bits: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            line, bounds = hashed(texts_of(batch))
            symbol, whole, text, p0, p1 = rows_of(mix(line, 500 + salt) if salt else line, bounds, window, rounds)
            symbol, whole = symbol >> _U(64 - bits), whole >> _U(64 - bits)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([_signed(symbol), _signed(whole), batch.column(0).take(at), batch.column(1).take(at), pa.array(p0.astype(np.int32)), pa.array(p1.astype(np.int32))], names=["symbol", "print", "doc_id", "version", "p0", "p1"])

    return parse


#: What is to be digested: a stretch that another document is said to hold, one that is held against it, or each window of a stretch.
CLAIM, ORIGIN, WINDOWS = 0, 1, 2


def _digests(window: int, most: int = 1 << 17):
    """Digests of the words of stretches (spans: kind, p0, p1; windows p0 to p1), one for each window of the kind WINDOWS."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            docs, versions, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(batch.schema.get_field_index("spans"))
            out: list[bytes] = []
            marks: list[tuple] = []

            def rows(out=out, marks=marks) -> pa.RecordBatch:
                d = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
                columns = [pa.array(c, t) for c, t in zip(zip(*marks, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                out.clear()
                marks.clear()
                return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), *columns], names=["d1", "d2", "doc_id", "version", "kind", "p0", "p1"])

            for doc, version, text, own in zip(docs, versions, texts_of(batch), spans, strict=True):
                words = text.split()
                line = memoryview(b" ".join(words))
                at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1))).tolist()
                for x in own.as_py():
                    kind, p0, p1 = x["kind"], x["p0"], x["p1"]
                    for a, b in [(p, p) for p in range(p0, p1 + 1)] if kind == WINDOWS else [(p0, p1)]:
                        out.append(hashlib.blake2b(line[at[a] : at[b + window] - 1], digest_size=16).digest())
                        marks.append((doc, version, kind, a, b))
                        if len(out) >= most:
                            yield rows()
            if out:
                yield rows()

    return digest


def _finish(window: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = batch.column(batch.schema.get_field_index("spans"))
            flat, counts = spans.flatten(), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            p0, p1 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            cuts = np.concatenate(([0], np.cumsum(counts)))
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                words = text.split()
                own = slice(cuts[i], cuts[i + 1])
                covered = np.bincount(p0[own], minlength=len(words) + 1) - np.bincount(p1[own] + window, minlength=len(words) + 1)
                gone = np.cumsum(covered[: len(words)]) > 0
                removed = int(gone.sum())
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if removed else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return finish


def _known(rows: DataFrame, info: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the value that info (keys, value, n; a row for each key) has for their key, null where it has none."""
    hot = info.orderBy(F.desc("n"), *keys).limit(HOT).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col(value).alias("_hot"))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    # What the hot keys have answered goes anywhere; those random keys meet nothing that counts.
    anywhere = lambda i: F.xxhash64(F.lit(i), "doc_id", "version", "p0")
    other = lambda k, i: F.struct(anywhere(i).alias("x"), anywhere(i + 1).alias("y")) if rows.schema[k].dataType.typeName() == "struct" else anywhere(i)
    dealt = marked.withColumns({f"_at_{k}": F.when(F.col("_hot").isNull(), F.col(k)).otherwise(other(k, i)) for i, k in enumerate(keys)})
    rest = info.select(*[F.col(k).alias(f"_own_{k}") for k in keys], F.col(value).alias("_value"))
    met = dealt.join(rest, [F.col(f"_at_{k}") == F.col(f"_own_{k}") for k in keys], "left")
    return met.select(*rows.columns, F.coalesce("_hot", "_value").alias(value))


def _holders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of several documents: the smallest of them, and its number of rows."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").drop("most")


def _paired(rows: DataFrame, level: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """One global round over rows (doc_id, version, p0, p1, name, least, several, level): the rows after it, and the stretches that the new names are held against."""
    in_order = Window.partitionBy("doc_id", "version").orderBy("p0")
    half = lambda c: F.pmod(F.xxhash64(F.lit(level + 1000 * salt), c), F.lit(2))
    follows = F.lead(F.struct("name", "p0", "p1")).over(in_order)
    placed = rows.withColumn("next", follows).withColumn("pair", F.coalesce((half("name") == 0) & (half("next.name") == 1) & (F.col("next.p0") == F.col("p1") + 1), F.lit(False)))
    placed = placed.withColumns({"left": F.when(F.col("pair"), F.col("name")), "right": F.when(F.col("pair"), F.col("next.name"))})
    info, info_path = stored(_holders(placed.filter("pair"), ["left", "right"]).withColumnRenamed("least", "holder"), "pairs")
    met, met_path = stored(_known(placed.drop("pair"), info, ["left", "right"], "holder"), "paired")
    name = F.struct(*[F.xxhash64(F.lit(seed + level + 1000 * salt), "left", "right").alias(k) for k, seed in (("x", 100), ("y", 200))])
    origins = met.filter("holder = doc_id").select("doc_id", "version", F.lit(ORIGIN).alias("kind"), "p0", F.col("next.p1").alias("p1"))
    taken = F.coalesce(F.col("holder") < F.col("doc_id"), F.lit(False))
    seen = met.withColumn("taken", taken).withColumn("second", F.coalesce(F.lag("taken").over(in_order), F.lit(False))).filter(~F.col("second"))
    after = seen.select("doc_id", "version", "p0", F.when(F.col("taken"), F.col("next.p1")).otherwise(F.col("p1")).alias("p1"), F.when(F.col("taken"), name).otherwise(F.col("name")).alias("name"), "least", "several", F.when(F.col("taken"), F.lit(level)).otherwise(F.col("level")).alias("level"))
    after, _ = stored(after, "symbols")
    origins, _ = stored(origins, "origins")
    forget(rows.sparkSession, info_path, met_path)
    return after, origins


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, levels: int = LEVELS, salt: int = 0, bits: int = 64) -> DataFrame:
    """A row for each row of df: id, n_words, n_removed, kept_sha256, kept_text (kept words, joined by one space). bits: of each half of the names of this salt; those of the next have 64."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(integer_id(df, id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("version"), column(text_col).alias("text"))
    parsed = docs.filter("doc_id is not null").select("doc_id", "version", "text").mapInArrow(_parse(window, rounds, salt, bits), "symbol long, print long, doc_id long, version long, p0 int, p1 int")
    rows, rows_path = stored(parsed, "recompressed")
    shared, shared_path = stored(_holders(rows, ["symbol"]), "shared-symbols")
    met, met_path = stored(_known(rows, shared, ["symbol"], "least").filter("least is not null").select("symbol", F.struct(F.col("symbol").alias("x"), F.col("print").alias("y")).alias("name"), "doc_id", "version", "p0", "p1").distinct(), "met")
    forget(spark, rows_path, shared_path)
    names, names_path = stored(_holders(met, ["name"]), "names")
    differ, differ_path = stored(met.groupBy("symbol").agg(F.min("name").alias("a"), F.max("name").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("symbol", "n", F.lit(True).alias("several")), "differing")
    found = _known(_known(met, names, ["name"], "least"), differ, ["symbol"], "several").filter("least is not null or several")
    symbols, _ = stored(found.select("doc_id", "version", "p0", "p1", "name", "least", F.coalesce("several", F.lit(False)).alias("several"), F.lit(0).alias("level")), "symbols")
    forget(spark, met_path, names_path, differ_path)
    origins = []
    for level in range(1, levels + 1):
        symbols, own = _paired(symbols, level, salt)
        origins.append(own)
    repeats = (F.col("level") > 0) | (F.col("least") < F.col("doc_id"))
    of = lambda rows, kind: rows.select("doc_id", "version", F.lit(kind).alias("kind"), "p0", "p1")
    spans = of(symbols.filter(repeats), CLAIM).unionAll(of(symbols.filter((F.col("level") == 0) & (F.col("least") == F.col("doc_id"))), ORIGIN)).unionAll(of(symbols.filter(~F.coalesce(repeats, F.lit(False)) & F.col("several")), WINDOWS))
    for own in origins:
        spans = spans.unionAll(own)
    spans, spans_path = stored(spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("kind", "p0", "p1")).alias("spans")), "spans")
    dealt = docs.join(spans, ["doc_id", "version"]).select("doc_id", "version", "text", "spans")
    read, read_path = stored(dealt.mapInArrow(_digests(window), "d1 long, d2 long, doc_id long, version long, kind int, p0 int, p1 int"), "digests")
    holders, holders_path = stored(_holders(read, ["d1", "d2"]), "holders")
    judged, judged_path = stored(_known(read.filter(F.col("kind") != ORIGIN), holders, ["d1", "d2"], "least").select("doc_id", "version", "kind", "p0", "p1", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("repeats")), "judged")
    forget(spark, spans_path, read_path, holders_path)
    if not judged.filter((F.col("kind") == CLAIM) & ~F.col("repeats")).isEmpty():
        forget(spark, judged_path)
        return dedup(df, id_col=id_col, text_col=text_col, window=window, rounds=rounds, levels=levels, salt=salt + 1)
    gone, _ = stored(judged.filter("repeats").groupBy("doc_id", "version").agg(F.collect_set(F.struct("p0", "p1")).alias("spans")), "repeats")
    forget(spark, judged_path)
    whole = docs.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("doc_id", id_col)


#: The contract, written out: all windows by their words, the smallest document of each, the words that later ones cover.
SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
     v as (select doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) as p from d),
     k as (select doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') as words from v),
     f as (select words, min(doc_id) as least from k group by words),
     g as (select distinct doc_id, unnest(range(p, p + {WINDOW})) as i from k join f using (words) where least < doc_id),
     e as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
     r as (select e.doc_id, coalesce(string_agg(w[i], ' ' order by i) filter (g.i is null), '') as kept, count(g.i) as n_removed from e left join g using (doc_id, i) group by e.doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
