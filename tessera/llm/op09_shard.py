"""Contiguous shards of equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import free, staged

#: A cut moves to the border of the group of equal texts it falls in if that group is at most this part of a shard.
LEAN = 0.002
LAW = "bytes"


def shards(docs: DataFrame, n: int = 8, texts: bool = False) -> DataFrame:
    """``docs`` (text, ...) with size, shard (0 to n - 1) and slot (gapless from 0 in its shard); other columns are kept, the text
    itself only if ``texts`` asks for it.

    size is the text's UTF-8 bytes (null: none) plus 1. Rows are ordered by (digest of the text, doc_id), dealt by
    range into partitions, and summed there; the partitions' totals, added up in order, give each row its
    global prefix. A row is in the shard in which its middle lies, cuts being at k/n of all bytes. Equal sizes come before groups: a
    cut within a group of equal texts moves to the group's nearer border only if the group is small (``LEAN`` of a shard); a larger
    group is split, so that no group of copies, however hot, unbalances the shards. Columns named like the results are replaced.
    Texts may have any length. An empty table gives an empty result; rows that are equal in everything are told apart by their place only.
    """
    docs = docs.drop("size", "shard", "slot")
    own = group, key, part, row, behind, ahead, b0, r0, at, no, first = free(docs, "group", "key", "part", "row", "behind", "ahead", "b0", "r0", "at", "no", "first")
    sized = docs.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, group: F.xxhash64("text", F.octet_length("text")), key: F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)})
    narrow = sized if texts else sized.drop("text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartitionByRange(parts, group, key).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    dealt = staged(dealt)  # from here on the partition of a row is data
    inside = Window.partitionBy(part).orderBy(group, key, row)
    totals = dealt.groupBy(part).agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = staged(totals.select(part, "b", F.coalesce(F.sum("b").over(order), F.lit(0)).alias(b0), F.coalesce(F.sum("r").over(order), F.lit(0)).alias(r0)))

    def placed(rows: DataFrame) -> DataFrame:
        summed = rows.withColumns({behind: F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), ahead: F.row_number().over(inside) - 1})
        return summed.join(before.drop("b"), part).withColumns({at: F.col(b0) + F.coalesce(behind, F.lit(0)), no: F.col(r0) + F.col(ahead)})

    total = before.agg(F.sum("b")).first()[0] or 0
    cuts = _moved(dealt, before, placed, [-(-total * k // n) for k in range(1, n)], total / n * LEAN, (group, part, b0, at)) if total else []
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col(at) + F.col("size") / 2 >= F.lit(c)).cast("int")
    whole = placed(dealt).withColumn("shard", shard)
    begin = whole.groupBy("shard").agg(F.min(no).alias(first))  # n rows
    return whole.join(F.broadcast(begin), "shard").withColumn("slot", F.col(no) - F.col(first)).drop(*own)


def _moved(dealt: DataFrame, before: DataFrame, placed, cuts: list[int], lean: float, names: tuple[str, str, str, str]) -> list[int]:
    """Where to cut: for each cut a border of the group that it falls in, or the cut itself if that group is large. Reads only the partitions concerned."""
    group, part, b0, at = names
    within = lambda low, size: F.array_compact(F.array(*(F.when((low <= c) & (low + size > c), c) for c in cuts)))
    holding = [r[0] for r in before.where(F.size(within(F.col(b0), F.col("b"))) > 0).select(part).collect()]  # len(cuts) at most
    met = placed(dealt.where(F.col(part).isin(holding))).select(F.explode(within(F.col(at), F.col("size"))).alias("cut"), group).collect()  # len(cuts)
    groups = list({r[1] for r in met})
    holding = [r[0] for r in dealt.where(F.col(group).isin(groups)).groupBy(part).agg(F.count("*")).collect()]  # partitions: numbers only
    ends = placed(dealt.where(F.col(part).isin(holding))).where(F.col(group).isin(groups)).groupBy(group).agg(F.min(at), F.max(F.col(at) + F.col("size")))
    border = {r[0]: (r[1], r[2]) for r in ends.collect()}  # len(cuts) at most
    out = {c: c for c in cuts}
    for cut, g in met:
        lo, hi = border[g]
        if hi - lo <= lean:
            out[cut] = lo if cut - lo < hi - cut else hi
    return [out[c] for c in cuts]


def write(docs: DataFrame, folder: str, n: int = 8) -> None:
    """The shards as Parquet files, one folder ``shard=k`` each, rows in the order of their slots."""
    shards(docs, n, texts=True).repartition(n, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
