"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Each source's documents are put in a shuffled order (by a hash of their id) on one line of words, and the line is cut
   into blocks of BLOCK words.
2. Targets: sources in order of code point (null last) weigh 5, 2, 1, repeating; they share a multiple of all words. A
   target stops at `most` times its source's size and the excess is reshared by weight. That is one level of water:
   sources sorted by cap over weight, the first ones capped, and prefix sums tell how many.
3. Schedule: slot k is at the golden-ratio point frac(k * 0.618...), which the cumulative targets map to a source. Slots
   are ranked within their source; rank r takes block r modulo the number of blocks, in epoch r div that number.
4. A source's schedule ends with the slot that fills its target, and that slot takes part of its block only. A source to
   which the points gave fewer slots than it needs (by the bounded discrepancy, a few) gets the rest at the end.
5. Slots join blocks, blocks join the documents that lie on them: the words taken.

Ranks and prefix sums are made in two steps (within BUCKETS hash buckets of a source or runs of slots, then over the sums
of those), so no task sees all rows of a source. What one task does see is a row for each source, when they are ordered. Sizes: null and empty texts have size 0, keep their row and take 0 words. A null source
is a source. Repeated rows and equal ids lie side by side on the line, each for itself. An empty table gives an empty
result. Other columns are not read. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 2048
BUCKETS = 1 << 12
RUN = 1 << 14
CELLS = 1024
GOLDEN = 0.6180339887498949


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From source and source_size (a row for each source): sid (0, 1, ... by code point, null last) and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    df = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    df = df.withColumns({"cap": F.col("source_size").cast("double") * most, "pool": F.sum(F.col("source_size").cast("double")).over(everything) * share})
    line = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    df = df.withColumn("capped", F.col("level") >= F.col("cap") / F.col("weight"))
    df = df.withColumns({"place": F.row_number().over(line)})
    df = df.withColumn("water", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("place"))).over(everything))
    return df.select("source", "source_size", "sid", F.when(F.col("capped") | F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))).alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """From sid, source_size and quota: sid, slot (its place in the whole mix), rank (within the source), for all slots of the mix."""
    spark = sources.sparkSession
    need = sources.filter("quota > 0").withColumns({"blocks": F.ceil(F.col("source_size") / block)})
    need = need.withColumn("need", (F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("quota") % F.col("source_size")) / block)).cast("long"))
    line = Window.orderBy("sid")
    need = need.withColumn("share", F.col("need") / F.sum("need").over(Window.partitionBy()))
    need = need.withColumns({"hi": F.sum("share").over(line.rowsBetween(Window.unboundedPreceding, 0)), "lo": F.coalesce(F.sum("share").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "last": F.lead("sid").over(line).isNull()})
    need = need.withColumn("hi", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("hi")))
    cells = need.select("sid", "lo", "hi", "need", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    total = need.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("slots")).first()["slots"]
    points = spark.range(int(total)).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("at")).withColumn("cell", F.floor(F.col("at") * CELLS))
    dealt = points.join(cells, "cell").filter("lo <= at and at < hi").select("sid", "need", "slot", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    offsets = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sid", "run", "before")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(offsets, ["sid", "run"]).select("sid", "slot", (F.col("before") + F.col("r")).alias("rank"), "need").filter("rank < need").drop("need")
    had = runs.groupBy("sid").agg(F.sum("n").alias("had"))
    tail = need.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need").select("sid", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select("sid", (F.lit(int(total)) + F.col("rank")).alias("slot"), "rank")
    return ranked.unionByName(tail)


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """A row for each row of df: id, size, source, source_size, target, taken, copies (how often the whole document is taken when only whole ones are: as often as its middle word), first_slot (of the mix; null where nothing is taken)."""
    key = F.xxhash64(F.lit(20), F.col("id"))
    base, _ = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size")).select("*", key.alias("key"), F.shiftrightunsigned(key, 64 - BUCKETS.bit_length() + 1).cast("int").alias("bucket")), "mix-sizes")
    sums, _ = stored(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    sources, _ = stored(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights).withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most)), "mix-targets")
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "bucket", "before")
    offsets = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(F.col("o.source").alias("o_source"), F.col("o.bucket").alias("o_bucket"), "before", "sid", "source_size", "target", "quota")
    place = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("at", F.coalesce(F.sum("size").over(place), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).select("id", "source", "size", "sid", "source_size", "target", (F.col("at") + F.col("before")).alias("at"))
    # A zero-size row shares its place with others: numbered, so that each stays a row.
    lying = rows.filter("size > 0")
    taken = (
        schedule(sources.select("sid", "source_size", "quota"), block)
        .join(sources.select("sid", "source_size", "quota"), "sid")
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumns({"epoch": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
        .withColumn("start", F.col("block") * block)
        .withColumn("until", F.least(F.col("start") + block, F.col("source_size"), F.col("quota") - F.col("epoch") * F.col("source_size")))
        .filter("until > start")
        .groupBy("sid", "block")
        .agg(F.sort_array(F.collect_list("until")).alias("untils"), F.min("slot").alias("slot"))
    )  # at most `most` slots take a block, so the list is short
    pieces = lying.select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    hit = pieces.join(taken, ["sid", "block"], "left")
    end, middle = F.col("at") + F.col("size"), F.col("at") + F.floor(F.col("size") / 2)
    words = F.aggregate("untils", F.lit(0).cast("long"), lambda a, u: a + F.greatest(F.lit(0).cast("long"), F.least(end, u) - F.greatest(F.col("at"), F.col("block") * block)))
    copies = F.when(F.floor(middle / block) == F.col("block"), F.aggregate("untils", F.lit(0).cast("long"), lambda a, u: a + F.when(u > middle, 1).otherwise(0)))
    got = hit.groupBy("id", "source", "size", "sid", "source_size", "target", "at").agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.coalesce(F.sum(copies), F.lit(0)).alias("copies"), F.min("slot").alias("first_slot"))
    none = rows.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    return got.unionByName(none).drop("sid", "at").withColumnRenamed("id", id_col)


def apply(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents: each row of df as often as mix() takes its middle word, 0 to `most` times; all columns of df, whatever their names. Equal rows share what they are taken together, rounded up."""
    # The row travels as one value, so that no name of its own meets another.
    of = lambda c: F.col(f"`{c}`")
    # Maps have no hash of their own.
    hashable = [F.to_json(F.struct(of(c))) if "map<" in df.schema[c].dataType.simpleString() else of(c) for c in df.columns]
    packed = df.select(F.struct("*").alias("row"), F.struct(of(id_col).alias("id"), F.xxhash64(*hashable).alias("row")).alias("key"), of(text_col).alias("text"), of(source_col).alias("source"))
    taken = mix(packed, id_col="key", text_col="text", source_col="source", **options)
    copies = taken.groupBy("key").agg(F.ceil(F.sum("copies") / F.count(F.lit(1))).alias("copies")).filter("copies > 0").select(F.col("key").alias("own"), "copies")
    met = packed.select("row", "key").join(copies, (F.col("key.row") == F.col("own.row")) & F.col("key.id").eqNullSafe(F.col("own.id")))
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")
