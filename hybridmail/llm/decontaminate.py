"""Benchmark decontamination: which documents hold most of a test item's word shingles.

Containment search with MinHash sketches, partitioned by the size of the item, so that a short item is found inside a
document of any length:

1. Words are runs of letters and digits of the lower-cased text; an item is its set of n-word shingles, as 64-bit hashes.
2. Items are dealt into partitions by the power of two of their set's size. An item's sketch is its smallest hashes
   (bottom-k MinHash), of one length for the partition: as many as a document with containment >= t can miss at the upper
   end of the partition's sizes, and MARGIN more (never more than the item has).
3. Only the sketches are probed, where the documents lie: no shingle of a document is shuffled, only those that a sketch
   has. An item of n shingles may miss m = n - ceil(t * n) of them in a document, so a pair is a candidate if it shares at
   least (sketch - m) sketch hashes, and if the document has ceil(t * n) shingles at all. That loses no pair, and drops
   documents that share a few common phrases with an item.
4. The shingles of the candidates' documents, and of no others, are counted exactly against the whole sets of the items
   that the document is a candidate for.

Items are broadcast in blocks of about BROADCAST_ROWS / 2 sketch hashes (their whole sets are at most five times as many):
a larger benchmark takes more passes, never a larger broadcast. Candidates lie in the shared folder.

Null texts and texts of fewer than n words have no shingles: such a document is never hit and such an item is never
found. Documents are told by id and text: repeated rows give their pairs once, other texts of one id (null ids too) are
judged each for itself. Equal items all match. Empty tables give an empty result. Columns other than id and text are passed on by `clean` and not read by `search`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridmail.llm.common import stored, table

SHINGLE = 5
CONTAINMENT = 0.8
BROADCAST_ROWS = 1_000_000
#: Sketch hashes beyond those that a containing document may miss.
MARGIN = 8
_SPLIT = r"[^\p{L}\p{N}]+"


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word shingles, in order, with repeats; null where there are fewer words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))

    return F.transform(F.array(words), of)[0]  # bound to a variable, the words are split once for each text


def items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", n: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """A row for each item: item_id, hs (its shingles, ascending), n_item, partition, sketch (how many of hs), wanted (sketch hashes that a candidate shares)."""
    df = benchmark.select(F.col(id_col).alias("item_id"), F.array_sort(F.array_distinct(shingles(F.col(text_col), n))).alias("hs")).filter("hs is not null").distinct()
    size = F.size("hs")
    df = df.select("item_id", "hs", size.alias("n_item"), F.floor(F.log2(size.cast("double"))).cast("int").alias("partition"))
    most_missed = lambda x: F.floor(x * (1 - t) + 1e-9).cast("int")
    upper = F.least(F.pow(F.lit(2.0), F.col("partition") + 1) - 1, F.lit(2.0**30))
    sketch = F.least(F.col("n_item"), most_missed(upper) + 1 + MARGIN)
    return df.withColumn("sketch", sketch).withColumn("wanted", F.col("sketch") - most_missed(F.col("n_item")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))


def blocks_of(known: DataFrame) -> list[DataFrame]:
    """The items in parts of at most about half BROADCAST_ROWS sketch hashes each, dealt by a hash."""
    rows = known.agg(F.coalesce(F.sum("sketch"), F.lit(0))).first()[0]
    n = max(1, -(-int(rows) // (BROADCAST_ROWS // 2)))
    return [known.filter(F.pmod(F.xxhash64(F.lit(6), "item_id", "hs"), F.lit(n)) == k) for k in range(n)]


def candidates(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """doc_id, version, item_id, item (a hash of its set) of the pairs that pass the sketches. known: one block of items()."""
    own = _keyed(docs, id_col, text_col).select("doc_id", "version", shingles(F.col("text"), n).alias("hs")).filter("hs is not null")
    own = own.select("doc_id", "version", F.size("hs").alias("n_doc"), F.explode("hs").alias("h"))
    least = F.ceil(F.col("n_item") * t - 1e-9)
    sketches = known.select("item_id", F.xxhash64("hs").alias("item"), "wanted", least.alias("least"), F.explode(F.slice("hs", F.lit(1), F.col("sketch"))).alias("h"))
    pair = ["doc_id", "version", "item_id", "item", "wanted"]
    met = own.join(F.broadcast(sketches), "h").filter("n_doc >= least").groupBy(*pair, "h").agg(F.lit(1).alias("one"))
    return met.groupBy(*pair).agg(F.count(F.lit(1)).alias("hits")).filter("hits >= wanted").select("doc_id", "version", "item_id", "item")


def search(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, t: float = CONTAINMENT) -> DataFrame:
    """Pairs doc_id, item_id with n_shared of n_item shingles and containment, where containment >= t."""
    # An id may be null, its hash with the text's isn't; the id itself is compared as well.
    key = F.xxhash64(F.lit(4), F.col("doc_id"), F.col("version"))
    keyed, out = _keyed(docs, id_col, text_col).withColumn("key", key), None
    for known in blocks_of(items(benchmark, n=n, t=t)):
        pairs, _ = stored(candidates(docs, known, id_col=id_col, text_col=text_col, n=n, t=t), "contained")
        sets = known.select(F.col("item_id").alias("_item_id"), F.xxhash64("hs").alias("item"), "hs")
        pairs = pairs.join(F.broadcast(sets), "item").filter(F.col("item_id").eqNullSafe(F.col("_item_id")))
        wanted = pairs.groupBy(key.alias("key")).agg(F.collect_set(F.struct("doc_id", "version", "item_id", "hs")).alias("of"))
        met = keyed.join(wanted, "key").select("doc_id", F.array_distinct(shingles(F.col("text"), n)).alias("own"), F.explode(F.filter("of", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["version"] == F.col("version")))).alias("of"))
        one = met.select("doc_id", "of.item_id", F.size(F.array_intersect("own", "of.hs")).cast("long").alias("n_shared"), F.size("of.hs").cast("long").alias("n_item"))
        out = one if out is None else out.unionByName(one)
    found = out.filter(F.col("n_shared") >= F.col("n_item") * t - 1e-9).distinct()
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that search() finds; a null id is kept."""
    hit = search(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs[id_col] == hit["_hit"], "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _sql(key: str, relation: str) -> str:
    return f"""select distinct {key}, array_to_string(w[i : i + {SHINGLE - 1}], ' ') as s
    from (select {key}, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from (select {key}, {_WORDS} as w from {relation}))"""


SQL = f"""
with d as ({_sql("doc_id", "documents")}),
     b as ({_sql("item_id", "benchmark")}),
     z as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment
from (select doc_id, item_id, count(*) as n_shared from d join b using (s) group by doc_id, item_id) join z using (item_id)
where n_shared >= n_item * {CONTAINMENT} - 1e-9
"""
