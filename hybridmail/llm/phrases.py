"""Phrase collocations: dictionary-encoded words, n-grams packed into fixed-width keys, range-partitioned radix sort.

1. Texts are read in blocks. A block's distinct words, with their language and count, become rows of their own; its text
   becomes a row of local word numbers, 0 wherever a piece or a text ends. Words are told apart by their bytes (hashes only
   bring equal ones together).
2. The dictionary holds the words that occur `least` times in a language: no phrase of rarer words can. They are numbered
   without gaps from 1, all languages on one line, so that a number stands for a word in a language.
3. The dictionary goes back to the blocks by a join on the words; where a word isn't in it, the piece breaks. N-grams of
   two and three numbers are packed into keys of a fixed width (one, two or three 64-bit numbers, by the size of the
   dictionary; the third is 0 for pairs), radix-sorted within the block and run-length counted.
4. A key's range follows from its first two words: the share of all words that come before the first in the dictionary,
   and within it the share that come before the second. So ranges hold about equal numbers of n-grams without a sample,
   and a word that begins a third of them is cut by the word that follows. A block sends each range one row. A range's keys
   are radix-sorted again, their counts summed, and those of `least` kept.
5. Counts of parts are joined to the candidates; cuts, the rule of longer phrases and the best of each language are plain
   columns, in decimals of 38 digits (counts up to 10**15).

Pieces end at . , ; : ! ? and line breaks; words at spaces and tabs; A-Z is lower-cased. Null texts are empty, a null
language is `und`, and joins a language of that name. A text is worked on whole. Repeated rows count each. A language without candidates
has no rows; nor has an empty table. Ids are not read, nor are other columns. A language that holds most rows is dealt by
words, keys and ranges of scores throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import column, edges, eights, forget, give_back, partitions, same_stretches, ship, slices, squeeze, stored, stretch, table, texts_of
from hybridmail.llm.substrings import hash_stretches, mix

LEAST, TOP = 10, 2000
#: A longer phrase of this share of a phrase's count (in percent) stands for it.
COVERED = 50
#: Bytes of text of a block; n-grams of a range, about.
BLOCK = 8 << 20
RANGE = 1 << 20
_U = np.uint64

_END = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8))
_INSIDE = ~(_END | np.isin(np.arange(256), np.frombuffer(b" \t", dtype=np.uint8)))


def numbered(data: bytes, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number (from 0) of its kind, and for each kind a word that is of it. Words are of one kind if their bytes and groups are equal."""
    hashes = hash_stretches(data, start, size) ^ mix(group.astype(_U), 61)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    line, own = eights(np.frombuffer(data + b"\0" * 8, dtype=np.uint8)), first[kind]
    same = (size == size[own]) & (group == group[own])
    same[same] = same_stretches(line, start[same], line, start[own[same]], size[same])
    if not same.all():  # two words of one hash: all that aren't the first of it are told apart one by one
        known: dict[tuple, int] = {}
        more = list(first)
        for i in np.flatnonzero(~same).tolist():
            word = (int(group[i]), data[start[i] : start[i] + size[i]])
            if word not in known:
                known[word] = len(more)
                more.append(i)
            kind[i] = known[word]
        first = np.array(more)
    return kind, first


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BLOCK):
        block = (part << 32) + k
        k += 1
        langs, codes = {}, []
        for lang in batch.column(0).to_pylist():
            codes.append(langs.setdefault(lang, len(langs)))
        texts = texts_of(batch)
        data = b"\n".join([*(t.lower() for t in texts), b""])
        start, size = edges(data, _INSIDE)
        if not len(start):
            continue
        begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
        group = np.repeat(np.array(codes), np.diff(np.searchsorted(start, begins)))
        kind, first = numbered(data, start, size, group)
        # Where a piece ends between two words a 0 is put; texts end with a line break.
        ends = np.concatenate(([0], np.cumsum(_END[np.frombuffer(data, dtype=np.uint8)])))
        broken = np.flatnonzero(ends[start[1:]] != ends[(start + size)[:-1]]) + 1
        line = np.insert(kind + 1, broken, 0)
        counts = np.bincount(kind, minlength=len(first))
        names = ["block", "lang", "word", "local", "n", "line"]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], pa.array([squeeze(line)], pa.binary())], names=names)
        spelled = list(langs)
        for i in range(0, len(first), 50_000):
            at = first[i : i + 50_000]
            words = pa.array([data[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array([spelled[g] for g in group[at].tolist()], pa.string()), words, pa.array(np.arange(i, i + len(at)), pa.int32()), pa.array(counts[i : i + len(at)]), pa.nulls(len(at), pa.binary())], names=names)
    give_back()


def columns_for(words: int) -> int:
    """How many 64-bit numbers hold three word numbers up to this."""
    bits = max(1, int(words).bit_length())
    return 1 if bits * 3 <= 64 else 2 if bits <= 32 else 3


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, words: int) -> np.ndarray:
    """Keys as rows of 64-bit numbers, the most significant first: they sort as (a, b, c) do."""
    a, b, c = (x.astype(_U) for x in (a, b, c))
    wide, bits = columns_for(words), _U(max(1, int(words).bit_length()))
    return np.stack([a << bits * _U(2) | b << bits | c]) if wide == 1 else np.stack([a, b << _U(32) | c]) if wide == 2 else np.stack([a, b, c])


def unpack(keys: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    bits = _U(max(1, int(words).bit_length()))
    if len(keys) == 3:
        out = tuple(keys)
    elif len(keys) == 2:
        out = (keys[0], keys[1] >> _U(32), keys[1] & _U(2**32 - 1))
    else:
        mask = (_U(1) << bits) - _U(1)
        out = (keys[0] >> bits * _U(2), keys[0] >> bits & mask, keys[0] & mask)
    return tuple(x.astype(np.int64) for x in out)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys, by their digits of 16 bits from the last; digits that all keys share are passed over."""
    order = np.arange(keys.shape[1])
    for column_ in keys[::-1]:
        if not len(column_):
            break
        differ = int(np.bitwise_or.reduce(column_ ^ column_[0]))
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                digit = (column_[order] >> _U(shift)).astype(np.uint16)  # numpy sorts 16-bit numbers by their counts
                order = order[np.argsort(digit, kind="stable")]
    return order


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    order = radix_order(keys)
    keys = keys[:, order]
    if not keys.shape[1]:
        return keys, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    if counts is None:
        return keys[:, new], np.diff(np.append(new, keys.shape[1]))
    return keys[:, new], np.add.reduceat(counts[order], new)


def ranges_of(cum: np.ndarray, own: np.ndarray, following: np.ndarray, total: float, ranges: int) -> np.ndarray:
    """The range of a pair from the words before its first one, that one's count, and the words before the second. It never falls as the key rises."""
    return np.minimum((cum + own * (following / total)) / total * ranges, ranges - 1).astype(np.int64)


def _grams(words: int, total: float, ranges: int):
    """Rows sorted by block: the numbers of its words in the dictionary, then its line."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, []
        for batch in batches:
            block, line = batch.column(0).to_numpy(), batch.column(5)
            edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if i == j:
                    continue
                if block[i] != now:
                    now, known = block[i], []
                last = line.slice(i, j - i).is_valid().to_numpy(zero_copy_only=False).any()  # the line is a block's last row
                known.append(tuple(batch.column(c).slice(i, j - i - last).to_numpy(zero_copy_only=False) for c in range(1, 5)))
                if last:
                    yield from sent(known, line[int(j) - 1].as_py())
                    known = []
        give_back()

    def sent(known: list, line: bytes) -> Iterator[pa.RecordBatch]:
        local, number, own, before = (np.concatenate(x) for x in zip(*known, strict=True))
        if not len(local):
            return
        places = stretch(line).astype(np.int64)
        size = int(max(places.max(), local.max() + 1)) + 1
        to = np.zeros(size, dtype=np.int64)
        to[local + 1] = np.arange(1, len(local) + 1)
        at = to[places]  # 0: a break, or a word that isn't in the dictionary
        pairs = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
        triples = pairs[:-1][pairs[1:] == pairs[:-1] + 1]
        first, second = np.concatenate((at[pairs], at[triples])) - 1, np.concatenate((at[pairs + 1], at[triples + 1])) - 1
        third = np.concatenate((np.zeros(len(pairs), dtype=np.int64), number[at[triples + 2] - 1]))
        if not len(first):
            return
        # Words of the block in the order of their numbers, so that ranges can be found again from sorted keys.
        keys, counts = counted(pack(number[first], number[second], third, words))
        a, b, _ = unpack(keys, words)
        order = np.argsort(number)
        x, y = order[np.searchsorted(number[order], a)], order[np.searchsorted(number[order], b)]
        place = ranges_of(before[x].astype(np.float64), own[x].astype(np.float64), before[y].astype(np.float64), total, ranges)
        cut = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
        rows = [(int(place[i]), b"".join(_column(k[i:j]) for k in keys), squeeze(counts[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "keys", "counts"])

    return grams


def _column(keys: np.ndarray) -> bytes:
    """A column of keys, as differences modulo 2**64, with its length in front."""
    data = squeeze(np.diff(keys, prepend=_U(0)))
    return len(data).to_bytes(8, "little") + data


def _columns(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.cumsum(stretch(data[at + 8 : at + 8 + n]), dtype=_U))
        at += 8 + n
    return np.stack(out)


def _merge(words: int, least: int):
    """Rows sorted by range: sums the counts of equal keys, and keeps those of at least `least`."""

    def merged(held: list) -> pa.RecordBatch:
        keys, counts = counted(np.concatenate([k for k, _ in held], axis=1), np.concatenate([c for _, c in held]))
        often = counts >= least
        return pa.RecordBatch.from_arrays([*map(pa.array, unpack(keys[:, often], words)), pa.array(counts[often])], names=["w1", "w2", "w3", "a"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for place, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if place != now and held:
                    yield merged(held)
                    held, size = [], 0
                now = place
                held.append((_columns(keys), stretch(counts).astype(np.int64)))
                size += held[-1][0].shape[1]
                if len(held) > 1 and size > 4 * RANGE:  # a range of many copies comes down to its distinct keys
                    keys, counts = counted(np.concatenate([k for k, _ in held], axis=1), np.concatenate([c for _, c in held]))
                    held, size = [(keys, counts)], 0
        if held:
            yield merged(held)
        give_back()

    return merge


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    over = (F.lit(1_000_000).cast("decimal(7,0)") * (_exact(a) * _exact(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (_exact(left) * _exact(right)).cast("decimal(31,0)")).cast("long")


def ngram_counts(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Words (lang, word, f, number) and n-grams (w1, w2, w3, a; w3 is 0 for pairs) of at least `least`, all words of each language (lang, n), and the paths they lie at."""
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).cast("string").alias("text"))
    blocks, blocks_path = stored(texts.mapInArrow(_read, "block long, lang string, word string, local int, n long, line binary"), "phrase-blocks", compression="zstd")
    found = blocks.filter("line is null")
    totals = found.groupBy("lang").agg(F.sum("n").alias("n"))
    often = found.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    rough, rough_path = stored(often.withColumn("m", F.monotonically_increasing_id()), "rough-dictionary")
    # Numbers without gaps: a partition's words begin where those of the partitions before it end. A row for each partition comes here.
    part, within = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    starts, words, total = [], 0, 0
    for r in rough.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("words"), F.sum("f").alias("f")).orderBy("part").collect():
        starts.append((r["part"], words, total))
        words, total = words + r["words"], total + r["f"]
    offsets = spark.createDataFrame(starts, "part long, first long, begin long")
    before = F.coalesce(F.sum("f").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dictionary, dictionary_path = stored(rough.withColumn("part", part).withColumns({"within": within, "before": before}).join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("first") + F.col("within") + 1).alias("number"), (F.col("begin") + F.col("before")).alias("before")), "dictionary")
    # At most two n-grams begin at a word.
    ranges = max(1, math.ceil(2 * total / RANGE))
    own = found.select("block", "lang", "word", "local").join(dictionary, ["lang", "word"]).select("block", "local", "number", "f", "before", F.lit(None).cast("binary").alias("line"))
    lines = blocks.filter("line is not null").select("block", *[F.lit(None).cast(t).alias(c) for c, t in (("local", "int"), ("number", "long"), ("f", "long"), ("before", "long"))], "line")
    met = own.unionByName(lines).repartition(partitions(spark), "block").sortWithinPartitions("block", F.col("local").asc_nulls_last())
    sent = met.mapInArrow(_grams(words, float(max(total, 1)), ranges), "range int, keys binary, counts binary")
    merged = sent.repartition(min(ranges, max(partitions(spark), ranges // 8)), "range").sortWithinPartitions("range").mapInArrow(_merge(words, least), "w1 long, w2 long, w3 long, a long")
    grams, grams_path = stored(merged, "n-grams")
    kept, totals_path = stored(totals, "language-sizes")
    forget(spark, blocks_path, rough_path)
    return dictionary, grams, kept, [dictionary_path, grams_path, totals_path]


def mine(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    spark = df.sparkSession
    dictionary, grams, totals, paths = ngram_counts(df, text_col=text_col, lang_col=lang_col, least=least)
    pairs = grams.filter("w3 = 0").select("w1", "w2", F.col("a").alias("f"))
    named = lambda k: dictionary.select(F.col("number").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *[F.col("lang")] * (k == 1))
    triples = grams.filter("w3 > 0")
    # The counts of a triple's first two and last two words; each is frequent, as the triple is.
    triples = triples.join(pairs.withColumnRenamed("f", "f12"), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    triples, triples_path = stored(triples.select("w1", "w2", "w3", "a", "f12", "f23"), "triples")
    longer = triples.select("w1", "w2", "a").unionAll(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    left = pairs.join(longer, ["w1", "w2"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * covered)).select("w1", "w2", F.lit(0).cast("long").alias("w3"), F.col("f").alias("a"), F.lit(None).cast("long").alias("f12"), F.lit(None).cast("long").alias("f23"))
    both = left.unionByName(triples).join(named(1), "w1").join(named(2), "w2").join(named(3), "w3", "left")
    two = F.col("word3").isNull()
    cut1 = F.struct(score(F.col("a"), F.col("f1"), F.when(two, F.col("f2")).otherwise(F.col("f23"))).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.when(two, F.col("f2")).otherwise(F.col("f23")).alias("r"))
    cut2 = F.when(~two, F.struct(score(F.col("a"), F.col("f12"), F.col("f3")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")))
    best = both.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.least(cut1, cut2).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranges over all languages: a row's rank is its place in its range after what earlier ranges hold of its language.
    lined, lined_path = stored(best.repartitionByRange(partitions(spark), "lang", *order).withColumn("range", F.spark_partition_id()), "phrase-ranges")
    held = lined.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < top).select("lang", "range", "before")
    ranked = lined.join(held, ["lang", "range"]).withColumn("rank", (F.col("before") + F.row_number().over(Window.partitionBy("range", "lang").orderBy(*order))).cast("long")).filter(F.col("rank") <= top)
    out, _ = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    forget(spark, triples_path, lined_path, *paths)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


#: The contract, written out: all n-grams of all pieces.
SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
     w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
     g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as g from w, (values (1), (2), (3)) v(k) where len(w) >= k),
     f as (select lang, k, g, count(*) as f from g group by all),
     n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
     c as (select lang, k, g as phrase, f as a, string_split(g, ' ') as w from f where k > 1 and f >= 10),
     cuts as (select lang, phrase, a, j, array_to_string(w[1 : j], ' ') as x, array_to_string(w[j + 1 :], ' ') as y from c, (values (1), (2)) v(j) where j < k),
     s as (select cuts.lang, phrase, a, j, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score from cuts join f x on x.lang = cuts.lang and x.g = cuts.x join f y on y.lang = cuts.lang and y.g = cuts.y),
     b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
     inside as (select lang, phrase, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from c where k = 3),
     gone as (select distinct b.lang, b.phrase from b join inside i on i.lang = b.lang and i.part = b.phrase where 100 * i.a >= 50 * b.a),
     r as (select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b anti join gone using (lang, phrase))
select lang, rank, phrase, a, l, r, n, score from r join n using (lang) where rank <= 2000
"""
