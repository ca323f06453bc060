"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, groups of equal texts kept whole.

The multi-way differencing method keeps partial partitions (one sum for each shard). It combines the two with the
largest spread, the fullest shard of one with the emptiest of the other, until one is left. Groups are dealt into
buckets by hash; each bucket is differenced in one task, then the buckets' partial partitions are differenced in turn,
at most ``FAN_IN`` at a time, so neither a task nor the driver ever holds all groups.

Defined cases: a null text has no bytes and counts as equal to an empty one; a group, or a very long text, that is larger than a
shard fills one by itself; repeated rows get slots one by one; rows with a null id are dealt like others, and come last
among rows of one block; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, spool, spread_join, tidied

#: Groups in a bucket, about; partial partitions that one task combines at most; rows in a slot block, about.
BUCKET_GROUPS, FAN_IN, SLOT_ROWS = 20_000, 4096, 50_000


def difference(sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions. Gives the final sums, and for each input and shard of it the final shard."""
    k = len(sums[0])
    # a node is (inputs or nodes below, with the shard of each that stands at a place); places are kept in rising order of sums
    first = [np.argsort(s, kind="stable") for s in sums]
    heap = [(-int(s[o[-1]] - s[o[0]]), i) for i, (s, o) in enumerate(zip(sums, first))]
    value = {i: s[o] for i, (s, o) in enumerate(zip(sums, first))}
    made: dict[int, tuple[int, int, np.ndarray]] = {}
    heapq.heapify(heap)
    following = len(sums)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = value.pop(a) + value.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        made[following] = (a, b, order)
        value[following] = total = total[order]
        heapq.heappush(heap, (-int(total[-1] - total[0]), following))
        following += 1
    root = heap[0][1]
    places = {root: np.arange(k)}  # final shard of each place of a node
    final = np.empty((len(sums), k), dtype=np.int32)
    for node in range(root, -1, -1):
        at = places.pop(node)
        if node in made:
            a, b, order = made[node]
            back = np.empty(k, dtype=np.int64)
            back[order] = at
            places[a], places[b] = back, back[::-1]
        else:
            final[node][first[node]] = at
    return value[root], final


def _bucket(shards: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["size", "gid"], ascending=[False, True])
        sums = []
        for size in groups["size"]:
            s = np.zeros(shards, np.int64)
            s[-1] = size
            sums.append(s)
        total, final = difference(sums)
        return pd.DataFrame({"bucket": groups.bucket, "gid": groups.gid, "place": final[:, -1], "sums": [total.tolist()] * 1 + [None] * (len(groups) - 1)})

    return run


def _combine(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("bucket")
    total, final = difference([np.asarray(s, np.int64) for s in parts.sums])
    return pd.DataFrame({"bucket": parts.bucket, "up": parts.up, "moves": [f.tolist() for f in final], "total": [total.tolist()] + [None] * (len(parts) - 1)})


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (gid binary, size long) with the shard of each, near-equal in total size."""
    n = groups.count()
    buckets = max(1, -(-n // BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    local = spool(dealt.groupBy("bucket").applyInPandas(_bucket(shards), "bucket long, gid binary, place int, sums array<long>"), "kk-local")
    parts, place = local.where("sums is not null").select("bucket", "sums"), local.select("gid", "bucket", "place")
    while buckets > 1:
        above = -(-buckets // FAN_IN)
        ups = spool(parts.withColumn("up", F.floor(F.col("bucket") / FAN_IN)).groupBy("up").applyInPandas(_combine, "bucket long, up long, moves array<int>, total array<long>"), "kk-up")
        place = place.join(ups.select("bucket", "up", "moves"), "bucket").select("gid", F.col("up").alias("bucket"), F.element_at("moves", F.col("place") + 1).alias("place"))
        parts, buckets = ups.where("total is not null").select(F.col("up").alias("bucket"), F.col("total").alias("sums")), above
    return place.select("gid", F.col("place").alias("shard"))


@tidied
def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null)."""
    text = F.col(text_col).cast("binary")
    own = spool(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256)).alias("gid"),
        ),
        "shard-rows",
    )
    groups = spool(own.groupBy("gid").agg(F.sum("size").alias("size"), F.count("*").alias("copies")), "shard-groups")
    sharded = spool(shard_groups(groups.select("gid", "size"), shards).join(groups.select("gid", "copies"), "gid"), "shard-places")
    placed = spread_join(own, sharded, ["gid"], "copies").drop("gid", "copies")
    n = own.count()
    placed = spool(placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(max(1, n // SLOT_ROWS)))), "shard-placed")
    blocks = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    slots = placed.withColumn("rn", F.row_number().over(inside)).join(starts, ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
