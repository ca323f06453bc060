"""The trie of what conversations begin with, and what sharing it would save.

A node is a distinct sequence of first turns (role, text). Conversations that begin with it are its members.

1. A turn is its digest (128 bits of SHA-256) and its number of code points; texts don't move. Turns get their places in their
   conversation; one longer than ``LONG`` turns (or a 50,000th of all) is numbered in ranges, so it lies in many tasks.
2. Prefixes are named by digests: turns fold within blocks of ``BLOCK`` turns, blocks by doubling. Equal prefixes get equal names.
3. Nodes are counted by name with a map-side half. A node with one member heads a chain: one leaf, nothing saved. Only nodes
   with two members and more enter the rounds.
4. Pointer jumping: every node adds its sum to the ancestor 2^k above it, which it points to, and then points twice as far up. The number of
   rounds is the logarithm of the depth, and a round holds only nodes that are that deep.
5. Ids that end at a node are joined in chunks of neighbouring ids; one digest runs over the chunks, as a stream where there are
   several.

Rows whose node is frequent meet it by ``spread_join``, at its copies.

Defined cases: null role and text count as empty; a null turn comes first; turns that tie are taken in the order of their digests, repeated
rows being turns of their own; rows without a conversation's id are left out; texts may be as long as a row allows; an empty table
gives no node (not even the root); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import lean, semi, spool, spread_join, tidied
from quarry.llm.sessions import crc32_sql
from quarry.operators.control import numbered

#: Turns that are folded in a row; turns of a conversation that are numbered in one task; ids to a chunk of a node's ends, at most.
BLOCK, LONG, ENDS = 64, 100_000, 1 << 16
_ROOT = bytearray(16)


def _name(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _joined(left: Column, right: Column) -> Column:
    return _name(F.lit(bytearray(b"+")), left, right)


def _digested(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, digest, points; one row a turn."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = _name(F.octet_length(role).cast("string").cast("binary"), F.lit(bytearray(b":")), role.cast("binary"), text.cast("binary"))
    own = conversations.where(F.col(conv_col).isNotNull())
    return own.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("points"))


def _placed(turns: DataFrame, counts: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest, points."""
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    whole = (F.row_number().over(Window.partitionBy("conv").orderBy(*order)) - 1).cast("long").alias("pos")
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    long = max(LONG, int(total) // 50_000)
    if most <= long:
        return turns.select("conv", whole, "digest", "points")
    hot = F.broadcast(counts.where(F.col("n") > long).select("conv"))  # at most 50,000
    ranged = numbered(turns.join(hot, "conv"), ["conv"], order).select("conv", (F.col("pos") - 1).cast("long").alias("pos"), "digest", "points")
    return turns.join(hot, "conv", "left_anti").select("conv", whole, "digest", "points").unionByName(ranged)


def _plain(placed: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: their turns (conv, d from 1, digest, points, total) and all conversations (conv, total)."""
    convs = counts.select("conv", "n", F.col("n").alias("total"))
    return spread_join(placed, convs, ["conv"], "n").select("conv", (F.col("pos") + 1).alias("d"), "digest", "points", "total"), convs.select("conv", "total")


def _spliced(placed: DataFrame, counts: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Like ``_plain`` after each conversation's first h turns were replaced by those of the last one whose id is a multiple of ``every``;
    h is crc32 of the id modulo ``most``."""
    base, h = F.col("conv") - F.col("conv") % every, F.crc32(F.col("conv").cast("string").cast("binary")) % most
    lent = counts.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.least("n", F.lit(most - 1)).alias("lent"))
    convs = counts.select("conv", "n", base.alias("base"), h.alias("h")).join(lent, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = spool(convs.select("conv", "base", "n", "h", "taken", "total"), "trie-convs")
    heads = placed.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("base"), "pos", "digest", "points")
    taken = convs.where("taken > 0").join(heads, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("d"), "digest", "points", "total")
    own = spread_join(placed, convs.drop("base"), ["conv"], "n").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "digest", "points", "total")
    return own.unionByName(taken), convs.select("conv", "total")


def _before(blocks: DataFrame, last: int) -> DataFrame:
    """For every block but the first: the name of all turns before it (``before``), and that of the node it goes on from (``above``)."""
    ends = spool(blocks.where((F.size("turns") == BLOCK) & ((F.col("block") + 1) * BLOCK < F.col("total"))).select("conv", "block", F.element_at("turns", -1)["name"].alias("own")), "trie-blocks")
    names, step = ends.withColumnRenamed("own", "upto"), 1
    while step < last:  # after it a name reaches over twice as many blocks
        earlier = names.select("conv", (F.col("block") + step).alias("block"), F.col("upto").alias("earlier"))
        far = names.join(earlier, ["conv", "block"], "left")
        names, step = spool(far.select("conv", "block", F.when(F.col("earlier").isNull(), F.col("upto")).otherwise(_joined(F.col("earlier"), F.col("upto"))).alias("upto")), "trie-names"), 2 * step
    earlier = names.select("conv", (F.col("block") + 1).alias("block"), F.col("upto").alias("earlier"))
    nodes = ends.join(earlier, ["conv", "block"], "left").select("conv", (F.col("block") + 1).alias("block"), F.when(F.col("earlier").isNull(), F.col("own")).otherwise(_joined(F.col("earlier"), F.col("own"))).alias("above"))
    return nodes.join(names.select("conv", (F.col("block") + 1).alias("block"), F.col("upto").alias("before")), ["conv", "block"])


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv, d, digest, points, total) to (conv, d, node, parent, points, total)."""
    grouped = turns.groupBy("conv", F.call_function("div", F.col("d") - 1, F.lit(BLOCK)).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("d", "digest", "points"))).alias("turns")
    )
    none = F.array().cast("array<struct<d:bigint,name:binary,points:bigint>>")

    def step(done: Column, turn: Column) -> Column:
        above = F.when(F.size(done) > 0, F.element_at(done, -1)["name"]).otherwise(F.lit(bytearray()))
        return F.concat(done, F.array(F.struct(turn["d"].cast("long").alias("d"), _name(above, turn["digest"]).alias("name"), turn["points"].alias("points"))))

    blocks = spool(grouped.select("conv", "block", "total", F.aggregate("turns", none, step).alias("turns")), "trie-turns")
    last = blocks.agg(F.max("block")).first()[0] or 0
    blocks = blocks.join(_before(blocks, last), ["conv", "block"], "left") if last else blocks.withColumns({"before": F.lit(None).cast("binary"), "above": F.lit(None).cast("binary")})
    named = F.transform("turns", lambda t: F.when(F.col("before").isNull(), t["name"]).otherwise(_joined(F.col("before"), t["name"])))
    parents = F.concat(F.array(F.coalesce("above", F.lit(_ROOT))), F.slice("names", 1, F.size("names") - 1))
    rows = blocks.withColumn("names", named).withColumn("above", parents)
    rows = rows.select("conv", "total", F.explode(F.arrays_zip("turns", "names", "above")).alias("t"))
    return rows.select("conv", F.col("t.turns.d").alias("d"), F.col("t.names").alias("node"), F.col("t.above").alias("parent"), F.col("t.turns.points").alias("points"), "total")


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, bucket, chunk) to (node, ends): a running digest, whatever the number of chunks."""
    key, run = None, None
    for batch in batches:
        out = []
        for node, chunk in zip(batch.column(0).to_pylist(), batch.column(2)):
            if node != key:
                if key is not None:
                    out.append((key, run.hexdigest()))
                key, run = node, hashlib.sha256(chunk.as_py().encode())
            else:
                run.update(b"," + chunk.as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([run.hexdigest()])], ["node", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(node, conv) of the conversations that end at a node to (node, ends): the digest of their ids, in order, joined by commas."""
    bucket = F.call_function("div", F.col("conv") - F.pmod(F.col("conv"), F.lit(ENDS)), F.lit(ENDS))
    chunks = members.groupBy("node", bucket.alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("chunk"))
    chunks = spool(chunks, "trie-ends")
    counts = chunks.groupBy("node").agg(F.count("*").alias("k"), F.first("chunk").alias("chunk"))
    one = counts.where("k = 1").select("node", F.sha2("chunk", 256).alias("ends"))
    more = semi(chunks, spool(counts.where("k > 1").select("node"), "trie-many"), "node").select("node", "bucket", "chunk")
    return one.unionByName(more.repartition("node").sortWithinPartitions("node", "bucket").mapInArrow(lean(_hash_chunks), "node binary, ends string"))


def _rolled(own: DataFrame, deepest: int) -> DataFrame:
    """``own`` (node, parent, depth, leaves, saved) to sums over subtrees (node, leaves, saved)."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts, reach = [own.select("node", "leaves", "saved")], 1
    active = own.where("depth >= 1").select("node", F.col("parent").alias("ptr"), "depth", "leaves", "saved")
    while reach <= deepest:
        given = spool(active.groupBy("ptr").agg(*sums, F.count("*").alias("n")).withColumnRenamed("ptr", "node"), "trie-given")
        parts.append(given.select("node", "leaves", "saved"))
        if 2 * reach > deepest:
            break
        hops = spool(given.select("node", "n").join(active.select("node", F.col("ptr").alias("next")), "node").withColumnRenamed("node", "ptr"), "trie-hops")
        moved = spread_join(active.where(F.col("depth") >= 2 * reach), hops, ["ptr"], "n").select("node", F.col("next").alias("ptr"), "depth", "leaves", "saved")
        more = given.select("node", F.col("leaves").alias("l"), F.col("saved").alias("s"))
        grown = moved.join(more, "node", "left")
        active = spool(grown.select("node", "ptr", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-active")
        reach *= 2
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(*sums)


@tidied
def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", splice: bool = False) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, (members - 1) * code points of the last text), ends_sha256. ``splice``: see ``_spliced``."""
    turns = spool(_digested(conversations, conv_col, turn_col, role_col, text_col), "trie-digests")
    counts = spool(turns.groupBy("conv").agg(F.count("*").alias("n")), "trie-counts")
    placed = spool(_placed(turns, counts), "trie-placed")
    sequences, convs = (_spliced if splice else _plain)(placed, counts)
    prefixes = spool(_prefixes(sequences), "trie-prefixes")
    root = F.lit(_ROOT).alias("node")
    zero = F.lit(0).cast("long")
    top = convs.groupBy().agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root, "conv", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), zero.alias("points"), "n_convs")
    below = prefixes.groupBy("node").agg(F.min("conv").alias("conv"), F.max("d").alias("depth"), F.max("parent").alias("parent"), F.max("points").alias("points"), F.count("*").alias("n_convs"))
    nodes = spool(below.unionByName(top), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"), F.count_if(F.col("n_convs") > 1).alias("n_shared"))
    full = spool(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").na.fill(0, ["n_children", "n_single", "n_shared"]), "trie-full")
    own = full.where("n_convs > 1 OR depth = 0").select(
        "node", "parent", "depth", (F.col("n_single") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved")
    )
    deepest = full.where("n_convs > 1").agg(F.max("depth")).first()[0] or 0
    sums = _rolled(spool(own, "trie-own"), deepest)
    ends = _ends(prefixes.where("d = total").select("node", "conv").unionByName(convs.where("total = 0").select(root, "conv")))
    known = full.join(sums, "node", "left").join(ends, "node", "left")
    known = spool(known, "trie-known")
    above = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    linked = spread_join(known.where("parent IS NOT NULL"), above.withColumnRenamed("n_children", "_below"), ["parent"], "_below")
    linked = linked.drop("_below").unionByName(known.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return linked.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), splice=True)


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {crc32_sql("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, pos + 1 AS d, r, x FROM c JOIN t ON t.conv_id = base AND pos < h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + pos - c.h + 1, r, x FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE pos >= c.h),
prefixes AS (
  SELECT conv_id, d, length(x) AS points, string_agg(sha256(strlen(r) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
lasts AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM prefixes),
nodes AS (
  SELECT node, d AS depth, left(node, 64 * (d - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM lasts GROUP BY node, d),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
sums AS (
  SELECT left(node, 64 * j) AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM known) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.node = k.node LEFT JOIN known p ON k.depth > 0 AND p.node = k.parent
"""
