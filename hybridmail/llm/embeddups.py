"""Embedding near-dedup: PCA-ordered tiled comparison with suffix bounds.

1. Equal vectors of one label form a class, which is compared once, whatever its number of copies.
2. For each length of vector an orthogonal basis is learned from a bounded sample: directions by their share of the squared
   lengths, so that leading dimensions hold as much of an inner product as can be; and the direction in which vectors
   differ most, the axis. Both only decide how much work is saved.
3. Two unit vectors of cosine `least` or more lie within r = sqrt(2 - 2 * least) of each other, and so do their places on
   the axis. Within each label, classes are put in the order of the axis and cut into tiles of TILE: counts of bins of
   r / FINE tell where tiles begin, and a bin that holds more than a tile is dealt over several. A tile meets itself and
   the tiles that reach within r of it, no others; each such pair of tiles is a task's block of its own, however many
   rows a label has.
4. In a block, products of the leading dimensions are accumulated first. What the others can add is at most the product of
   the two suffix norms: a pair goes on to further dimensions only while that can reach `least`. What is left is decided by
   the cosine of the original vectors, in double precision.
5. Of a block's links only sums come out: for each class how many vectors it is linked with, and the first class of its
   group within the block. So a group of thousands of near copies gives rows in proportion to its tiles, not its pairs, and
   no link is lost. Groups of all blocks are put together by alternating stars.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null label;
they keep a row, with 0 links and themselves as component. Vectors of different lengths have no cosine and don't link. Very large
and very small components are scaled before they are squared. Each row of the table has a row; repeated rows (of one id,
label and vector) count once. An id with several vectors has each one's links in its rows, and one component for all. Null ids
link with nothing; their component is null, and they are kept. An empty table gives no rows. Other columns are not read.
Ids are integers; labels may be of any type that casts to a string.

On the driver: the samples (SAMPLE_BYTES for each length) and a basis for each length. No pair is left out or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridmail.llm.common import column, forget, give_back, integer_id, partitions, ship, stored, table
from hybridmail.llm.components import components

LEAST = 0.98
TILE = 1024
#: Bins of the axis in a radius.
FINE = 64
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
#: Dimensions after which bounds are tested for all pairs of a block, and by how many more they are tested again.
LEADING = 8
#: Rows of a tile that are compared with the other tile at once.
STEP = 64
#: What rounding may take from a bound.
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1, however large or small their components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def basis(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: an orthogonal basis (columns), by falling share of the squared lengths, and the axis of the largest variance."""
    moment = x.T @ x
    _, turned = np.linalg.eigh(moment)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    _, spread = np.linalg.eigh(moment - len(x) * np.outer(mean, mean))
    return np.ascontiguousarray(turned[:, ::-1]), np.ascontiguousarray(spread[:, -1])


def near_pairs(x: np.ndarray, y: np.ndarray, turned: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of the pairs of unit vectors of cosine least or more; p < q if x and y are the same."""
    d = x.shape[1]
    a, b = x @ turned, y @ turned
    cuts = [*range(LEADING, d, LEADING), d]
    cuts = [c for k, c in enumerate(cuts) if k == 0 or c == d or (c // LEADING) & (c // LEADING - 1) == 0]  # each test after twice as many
    rest = lambda z: np.stack([np.sqrt(np.maximum(0.0, np.einsum("nd,nd->n", z[:, c:], z[:, c:]))) for c in cuts])
    after_a, after_b = rest(a), rest(b)
    for i in range(0, len(a), STEP):
        # Pairs of this strip whose leading dimensions leave the threshold within reach.
        sums = a[i : i + STEP, : cuts[0]] @ b[:, : cuts[0]].T
        p, q = np.nonzero(sums + after_a[0, i : i + STEP, None] * after_b[0][None] >= least - SLACK)
        if same:
            p, q = p[p + i < q], q[p + i < q]
        sums = sums[p, q]
        p = p + i
        for k in range(1, len(cuts)):
            if not len(p):
                break
            s = slice(cuts[k - 1], cuts[k])
            sums = sums + np.einsum("nd,nd->n", a[p, s], b[q, s])
            alive = sums + after_a[k, p] * after_b[k, q] >= least - SLACK
            p, q, sums = p[alive], q[alive], sums[alive]
        if len(p):
            linked = np.einsum("nd,nd->n", x[p], y[q]) >= least
            if linked.any():
                yield p[linked], q[linked]


def first_of_group(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (p, q) connect it with."""
    first = np.arange(n)
    while True:
        least = np.minimum(first[p], first[q])
        after = first.copy()
        for side in (first[p], first[q], p, q):
            np.minimum.at(after, side, least)
        after = after[after]
        if (after == first).all():
            return first
        first = after


def _compare(turned: dict[int, np.ndarray], least: float):
    """Rows sorted by block: label, space, i, j, tile, key, node, n, v. Gives key, node, first (a node of its group), links (of its vectors with others in the block)."""

    def block(rows: pd.DataFrame) -> pa.RecordBatch | None:
        space, i, j = int(rows["space"].iloc[0]), int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        tile = rows["tile"].to_numpy()
        own, other = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        if not len(own) or not len(other):
            return None
        vectors = units(np.stack(rows["v"].to_numpy()))
        n = rows["n"].to_numpy()
        links, ps, qs = np.zeros(len(rows), dtype=np.int64), [], []
        for p, q in near_pairs(vectors[own], vectors[other], turned[space], least, i == j):
            p, q = own[p], other[q]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            ps.append(p)
            qs.append(q)
        if not ps:
            return None
        at, node, key = np.flatnonzero(links), rows["node"].to_numpy(), rows["key"].to_numpy()
        first = first_of_group(len(rows), np.concatenate(ps), np.concatenate(qs))
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), pa.array(node[first[at]]), pa.array(links[at])], names=["key", "node", "first", "links"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            marks = rows[["label", "space", "i", "j"]].to_numpy()
            edge = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                place = tuple(marks[a])
                if place != now and held:
                    found = block(pd.concat(held))
                    held = []
                    if found is not None:
                        yield found
                now = place
                held.append(rows.iloc[a:b])
        if held and (found := block(pd.concat(held))) is not None:
            yield found
        give_back()

    return compare


def _places(axes: dict[int, np.ndarray], width: float):
    """Adds each vector's bin on the axis of its length."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space, vectors = batch.column(0).to_numpy(), batch.column(batch.schema.get_field_index("v")).to_pandas()
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for d in np.unique(space):
                at = np.flatnonzero(space == d)
                out[at] = np.floor(units(np.stack(vectors.iloc[at].to_numpy())) @ axes[int(d)] / width).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "bin"])

    return places


def find(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """A row for each row of df: its id, n_links, component_id, kept."""
    spark = df.sparkSession
    ship(spark)
    v = F.col("v")
    kind = "float" if "float" in df.schema[vector_col].dataType.simpleString() else "double"
    fit_for = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(integer_id(df, id_col).alias("id"), column(vector_col).cast(f"array<{kind}>").alias("v"), column(label_col).cast("string").alias("label"))
    fit_rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fit_for, F.lit(False)))
    # A class: its smallest id stands for it among links, the key among sums. Ids of a class are counted over its distinct rows.
    grouped = fit_rows.distinct().groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes, classes_path = stored(grouped.select(F.size("v").alias("space"), F.monotonically_increasing_id().alias("key"), "label", "node", "n", "v"), "vector-classes")
    counts = {r["space"]: r["count"] for r in classes.groupBy("space").count().collect()}  # a row for each length
    turned, axes = {}, {}
    share = F.lit(0.0)
    for d, n in counts.items():
        share = F.when(F.col("space") == d, min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * d) + 1) / n)).otherwise(share)
    sample = classes.filter(F.pmod(F.xxhash64(F.lit(13), "v"), F.lit(1 << 30)) < share * (1 << 30)).select("space", "v").toPandas() if counts else pd.DataFrame({"space": [], "v": []})
    for d in counts:
        x = sample["v"][sample["space"] == d]
        turned[d], axes[d] = basis(units(np.stack(x.to_numpy())) if len(x) else np.zeros((0, d)))
    radius = math.sqrt(2 - 2 * least + 1e-12)
    lying, lying_path = stored(classes.mapInArrow(_places(axes, radius / FINE), f"space int, key long, label string, node long, n long, v array<{kind}>, bin long"), "axis-places")
    # Tiles by the bins' counts: a bin begins in tile `low` and ends in tile `high`. Bins of a label number at most 2 * FINE / radius.
    along = Window.partitionBy("label", "space").orderBy("bin")
    bins = lying.groupBy("label", "space", "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("until", F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumns({"low": F.floor((F.col("until") - F.col("c")) / TILE), "high": F.floor((F.col("until") - 1) / TILE)})
    bins = bins.withColumns({"reach": F.max("high").over(along.rangeBetween(0, FINE + 2)), "back": F.min("low").over(along.rangeBetween(-FINE - 2, 0))})
    tiles = bins.select("label", "space", F.explode(F.sequence("low", "high")).alias("tile"), "reach", "back").groupBy("label", "space", "tile").agg(F.max("reach").alias("reach"), F.min("back").alias("back"))
    placed = lying.join(bins.select("label", "space", "bin", "low", "high"), ["label", "space", "bin"]).withColumn("tile", F.col("low") + F.pmod(F.xxhash64("key"), F.col("high") - F.col("low") + 1)).drop("bin", "low", "high")
    sent = placed.join(tiles, ["label", "space", "tile"]).select("label", "space", "tile", "key", "node", "n", "v", F.explode(F.sequence("back", "reach")).alias("other"))
    sent = sent.select("label", "space", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "key", "node", "n", "v")
    met = sent.repartition(partitions(spark), "label", "space", "i", "j").sortWithinPartitions("label", "space", "i", "j")
    links, links_path = stored(met.mapInArrow(_compare(turned, least), "key long, node long, first long, links long"), "vector-links")
    sums = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = fit_rows.distinct().join(classes.select("label", "v", "key", "node", "n"), ["label", "v"]).join(sums, "key", "left").select("id", "label", "v", "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known, known_path = stored(known, "vector-sums")
    # The classes that rows of one id are in hang together by the id.
    by_id = known.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    joined = known.select("id", "node").distinct().join(by_id.filter("least < most"), "id").select("least", "node")
    whole = components(links.select("node", "first").unionAll(joined), "node", "first").withColumnRenamed("node", "of")
    owner = by_id.select(F.col("id").alias("own"), "least").join(whole, F.col("least") == F.col("of"), "left").select("own", F.coalesce("component", "least").alias("component"))
    linked = known.select(F.col("id").alias("k_id"), F.col("label").alias("k_label"), F.col("v").alias("k_v"), "n_links")
    out = rows.join(linked, (F.col("id") == F.col("k_id")) & (F.col("label") == F.col("k_label")) & (v == F.col("k_v")), "left").join(owner, F.col("id") == F.col("own"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    found = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    result, _ = stored(found, "vector-groups")
    forget(spark, classes_path, lying_path, links_path, known_path)
    return result


def dedup(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """The rows of df whose id is the smallest of its group; all columns."""
    gone = find(df, id_col=id_col, vector_col=vector_col, label_col=label_col, least=least).filter("not kept").select(column(id_col).alias("_gone")).distinct()
    return df.join(gone, df[f"`{id_col}`"] == gone["_gone"], "left_anti")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "embeddings"))


#: The contract, written out: all pairs of a label, and the closure of the links.
SQL = """
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings
                     where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
     u as (select vec_id, label, v, sqrt(list_inner_product(v, v)) as norm from v),
     e as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v) where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
     l as (select x, y from e union all select y, x from e),
     r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.y from r join l on r.b = l.x),
     n as (select x as vec_id, count(*) as n from l group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, least as component_id, vec_id = least as kept
from (select a as vec_id, min(b) as least from r group by a) left join n using (vec_id)
"""
