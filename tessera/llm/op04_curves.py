"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected (random orthogonal directions, another set for each curve), scaled
to ranks by quantiles of a bounded sample, shifted, and put on a Hilbert curve. Each
curve's keys are sorted by range partitioning; partition totals give every vector its
place. A query meets the vectors within ``window`` places of its own on each curve, block
by block; what the blocks find is merged and ranked again on the original vectors.

Equal vectors are one entry of the index, with its smallest ids: a vector that a third
of all rows share takes one place, and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import staged

#: Rows that the quantiles are fitted on, at most (those of the smallest hash); every row is indexed.
SAMPLE = 8_000
#: Relative and absolute error of a squared distance as searched: what is that near to the last of a shortlist stays in it.
NEAR = 1e-9
#: Directions of a curve, bits of each, and places in a block.
DIRECTIONS, BITS, BLOCK = 8, 4, 1024


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = 24, window: int = 256, share: float = 0.015, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding; others are ignored) with ``is_query`` its k nearest found.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; a row is not its own
    neighbour, nor are rows with its vec_id. The window is ``window`` places or ``share`` of the distinct vectors to each side,
    whichever is more: a share keeps recall where vectors are spread evenly, a fixed window keeps the
    cost of a query fixed. Null, zero-length, all-zero and non-finite vectors and null ids take no part, nor do vectors
    of another dimension than the most frequent one. Repeated rows count once.
    """
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v"), is_query.alias("q"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes.d).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    least = rows.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    index = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 ids each
    index = staged(index.withColumn("gid", F.monotonically_increasing_id()))
    asked = staged(rows.where(F.coalesce("q", F.lit(False))).select("v", F.col("vec_id").alias("query_id")).distinct().join(index.select("v", "gid"), "v"))
    total = index.count()
    reach = max(window, int(share * total))
    sample = [r.v for r in index.select("v").orderBy(F.xxhash64("v"), "gid").limit(SAMPLE).collect()]  # bounded
    # components given as floats are exact as such, others are searched in double precision
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    placed = _placed(index, asked.select("gid").distinct(), _fitted(np.array(sample), curves, seed), kind)
    pairs = _searched(placed, reach, k + 1, kind)
    best = Window.partitionBy("q").orderBy("d")
    pairs = pairs.groupBy("q", "gid").agg(F.min("d").alias("d"))
    # the k + 1 nearest and whatever is as near as the last of them, but for rounding
    pairs = pairs.withColumn("n", F.row_number().over(best)).withColumn("edge", F.max(F.when(F.col("n") <= k + 1, F.col("d"))).over(Window.partitionBy("q")))
    pairs = pairs.where(F.col("d") <= F.col("edge") * (1 + NEAR) + NEAR)
    one, other = index.select(F.col("gid").alias("q"), F.col("v").alias("a")), index.select("gid", F.col("v").alias("b"), "ids")
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.select("q", "gid").join(other, "gid").join(one, "q").select("q", "ids", F.sqrt(square).alias("score"))
    # of all vectors found for a point, the k + 1 nearest (id, score) are enough for each row that asks
    near = exact.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    near = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    rest = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(near, F.col("gid") == F.col("q")).select("query_id", F.posexplode(rest).alias("rank", "found"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))


def _fitted(sample: np.ndarray, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each curve: directions, the sample's quantiles along them, shifts."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    found = []
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(max(d, DIRECTIONS), max(d, DIRECTIONS))))[0][:d, :DIRECTIONS]
        found.append((axes, np.quantile(sample @ axes, np.linspace(0, 1, 257), axis=0), rng.random(DIRECTIONS) * 0.25))
    return found


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of small integers (Skilling's transposition)."""
    x = [c.copy() for c in cells.T.astype(np.uint32)]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(len(x)):
            swap = np.where(x[i] & np.uint32(q), np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & np.uint32(q), x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & np.uint32(q), turn ^ np.uint32(q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> np.uint32(b) & np.uint32(1)).astype(np.int64)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(index: DataFrame, asked: DataFrame, fitted: list, kind: str) -> DataFrame:
    """(curve, place, gid, v, asks): every vector once on every curve."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            small = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            for c, (axes, edges, shift) in enumerate(fitted):
                y = x @ axes
                rank = np.stack([np.searchsorted(edges[:, i], y[:, i]) / len(edges) for i in range(y.shape[1])], 1)
                cell = np.clip((rank * 0.75 + shift) * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), pa.array(hilbert(cell, BITS)), b.column("gid"), small, b.column("asks")], ["curve", "key", "gid", "v", "asks"])

    marked = index.join(asked.withColumn("asks", F.lit(True)), "gid", "left").select("gid", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = marked.mapInArrow(keys, "curve int, key long, gid long, v binary, asks boolean").repartitionByRange(parts, "curve", "key", "gid")
    keyed = staged(keyed.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "curve").orderBy("key", "gid")
    totals = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = totals.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return keyed.withColumn("at", F.row_number().over(inside) - 1).join(before.select("curve", "part", "base"), ["curve", "part"]).select("curve", (F.col("base") + F.col("at")).alias("place"), "gid", "v", "asks")


def _searched(placed: DataFrame, reach: int, most: int, kind: str) -> DataFrame:
    """(q, gid, d): for each query and block within reach the ``most`` nearest there by squared distance, and what is as near as the last."""
    entries = placed.withColumn("block", F.floor(F.col("place") / BLOCK))
    first, last = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / BLOCK), F.floor((F.col("place") + reach) / BLOCK)
    asking = placed.where("asks").withColumn("block", F.explode(F.sequence(first, last)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        a = np.frombuffer(b"".join(left.column("v").to_pylist()), kind).reshape(len(left), -1).astype(np.float64)
        b = np.frombuffer(b"".join(right.column("v").to_pylist()), kind).reshape(len(right), -1).astype(np.float64)
        gid, q = left.column("gid").to_numpy(), right.column("gid").to_numpy()
        place, own = left.column("place").to_numpy(), right.column("place").to_numpy()
        found = []
        for lo in range(0, len(q), 512):
            rows = slice(lo, lo + 512)
            d = np.maximum((a * a).sum(1)[None] + (b[rows] * b[rows]).sum(1)[:, None] - 2 * b[rows] @ a.T, 0)
            d[np.abs(place[None] - own[rows, None]) > reach] = np.inf
            edge = np.partition(d, min(most, d.shape[1]) - 1, 1)[:, min(most, d.shape[1]) - 1]
            row, at = np.nonzero((d <= (edge * (1 + NEAR) + NEAR)[:, None]) & (d < np.inf))
            found.append((q[rows][row], gid[at], d[row, at]))
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("q", "gid", "d"), zip(*found, strict=True), strict=True)})

    entries, asking = (x.select("curve", "block", "place", "gid", "v").toDF("curve", "block", "place", "gid", "v") for x in (entries, asking))
    return entries.groupBy("curve", "block").cogroup(asking.groupBy("curve", "block")).applyInArrow(meet, "q long, gid long, d double")
