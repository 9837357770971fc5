"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes, then rewrite affected files.

A layout is a folder of Parquet files by part, a part being a bundle of blocks of one shard. The flow says how many bytes go
from which shard to which; whole bundles go as far as they can, so that few files hold rows that move. Those files alone are read and
written again, as a next generation beside the old one, of which the other files stay as they are.

The driver sees only block sizes, of which there are old_shards * BLOCKS at most whatever the input's size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .shared import documents, new_path

#: Blocks of one shard, whole groups of equal texts by their hash, the units that are moved; bundles of them, which are files;
#: bytes of a file from which a bundle has several.
BLOCKS, BUNDLES, FILE_BYTES = 1024, 16, 256 << 20
#: Cells of a shard within which rows are numbered; slots follow the cells.
CELLS = 512


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink at the least total cost; all supply is placed (sum(capacity) must suffice).

    Successive shortest paths with potentials (Dijkstra on reduced costs) over the bipartite graph.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("the new shards cannot hold all bytes")
    height = [0] * (n + m)  # potentials: sources, then sinks
    while any(left):
        dist, via = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            edges = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                if (e := d + c + height[u] - height[v]) < dist[v]:
                    dist[v], via[v] = e, u
                    heapq.heappush(heap, (e, v))
        sink = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j] + height[n + j])
        far = max(d for d in dist if d < float("inf"))
        height = [h + min(d, far) for h, d in zip(height, dist)]
        path = [n + sink]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[sink], *(flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[sink] -= amount
    return flow


def transfers(blocks: dict[tuple[int, int], int], old: int, new: int) -> tuple[dict[tuple[int, int], int], int]:
    """The new shard of each block (old shard, number) with its bytes, and the fewest bytes that could move if blocks could be split.

    Blocks larger than a share have shards of their own; the others go by the flow's amounts in whole blocks, bundle after
    bundle, evened out until no move helps.
    """
    rest, large, least = sum(blocks.values()), [], 0
    have = [0] * old
    for (i, _), size in blocks.items():
        have[i] += size
    for key in sorted(blocks, key=lambda k: (-blocks[k], k)):
        if blocks[key] * (new - len(large)) <= rest:
            break
        large.append(key)
        rest -= blocks[key]
        have[key[0]] -= blocks[key]
    where, free = {}, set(range(new))
    for key in large:  # the largest of an old shard stays: it is more than the share that could stay in its place
        if key[0] in free:
            where[key] = key[0]
            free.remove(key[0])
    for key in large:
        if key not in where:
            # the shard in which the least could have stayed
            where[key] = min(free, key=lambda j: (have[j] if j < old else 0, -j))
            free.remove(where[key])
            least += blocks[key]
    sinks = np.array(sorted(free))
    capacity = [rest // len(sinks) + (j < rest % len(sinks)) for j in range(len(sinks))]
    flow = min_cost_flow(have, capacity, [[int(i != j) for j in sinks.tolist()] for i in range(old)])
    home = {int(j): n for n, j in enumerate(sinks)}
    bundle = lambda k: (k[0], k[1] * BUNDLES // BLOCKS)
    keys = sorted(blocks.keys() - where.keys(), key=lambda k: (bundle(k), -blocks[k], k))
    size = np.array([blocks[k] for k in keys], np.int64)
    need = [np.array(row, np.int64) for row in flow]
    stay = np.array([need[i][home[i]] if i in home else 0 for i in range(old)], np.int64)
    least += int(sum(row.sum() for row in need) - stay.sum())
    at, load = np.zeros(len(keys), np.int64), np.zeros(len(sinks), np.int64)
    away = []
    for n, (i, _) in enumerate(keys):  # the first bundles stay
        if i in home and (stay[i] >= size[n] / 2 or size[n] == 0):
            stay[i] -= size[n]
            at[n] = home[i]
            load[at[n]] += size[n]
        else:
            away.append(n)
    for i, j in home.items():
        if i < old:
            need[i][j] = np.iinfo(np.int64).min // 2
    for n in sorted(away, key=lambda n: (-size[n], n)):  # the largest first, each to where most is still wanted
        at[n] = j = int(np.argmax(need[keys[n][0]]))
        need[keys[n][0]][j] -= size[n]
        load[j] += size[n]
    open_bundles = {bundle(keys[n]) for n in away}
    opened = np.array([bundle(k) in open_bundles for k in keys], bool)
    while len(keys):  # even out what whole blocks have left over; every move makes the sum of squares smaller
        b = int(np.argmin(load))
        gap = load[at] - load[b]
        helps = np.flatnonzero((size > 0) & (size < gap))
        if not len(helps):
            break
        helps = helps[opened[helps]] if opened[helps].any() else helps  # of files that are rewritten anyway, if there is one
        helps = helps[gap[helps] == gap[helps].max()]  # from the fullest shard that has such a block
        n = int(helps[np.argmin(np.abs(gap[helps] - 2 * size[helps]))])
        load[at[n]] -= size[n]
        load[b] += size[n]
        at[n] = b
        opened |= np.array([bundle(k) == bundle(keys[n]) for k in keys]) if not opened[n] else False
    return where | {k: int(j) for k, j in zip(keys, sinks[at])}, least


@dataclass
class Layout:
    """Shards as Parquet files: generations of folders, each with the parts that a later one has replaced."""

    spark: SparkSession
    schema: T.StructType
    shards: int
    generations: list[tuple[str, list[int]]]

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """row (the columns of the table), size, hash, block and part of all rows, or of those in some parts; other files are not touched."""
        out = None
        for path, gone in self.generations:
            df = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
            df = df.where(~F.col("part").isin(gone)) if gone else df
            df = df if parts is None else df.where(F.col("part").isin(parts))
            out = df if out is None else out.unionByName(df)
        return out.withColumn("shard", F.floor(F.col("part") / BUNDLES).cast("int"))

    def sizes(self) -> dict[tuple[int, int], int]:
        """Bytes of each block (shard, number), from narrow columns."""
        rows = self.read().groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
        return {(r["shard"], r["block"]): r["bytes"] for r in rows.toLocalIterator()}  # shards * BLOCKS rows at most


def lay_out(docs: DataFrame, size: Column, group: Column, shards: int, path: str, shard: Column | None = None) -> Layout:
    """Write docs (doc_id and any other columns) as a layout under `path`: rows with one `group` hash in one block, without `shard` also in one shard by that hash."""
    spark = docs.sparkSession
    h = F.xxhash64(group)
    rows = docs.select(F.struct(*docs.columns).alias("row"), size.alias("size"), h.alias("hash"), (F.pmod(h, F.lit(shards)) if shard is None else shard).cast("int").alias("shard"))
    rows = rows.withColumn("block", F.pmod(F.shiftright("hash", 20), F.lit(BLOCKS)).cast("int"))
    rows = rows.withColumn("part", (F.col("shard") * BUNDLES + F.floor(F.col("block") * BUNDLES / BLOCKS)).cast("int")).drop("shard")
    # a part that holds a large group is written by several tasks: none has much more than its share of the rows or bytes
    tasks, every = int(spark.conf.get("spark.sql.shuffle.partitions")), W.Window.partitionBy()  # shards * BUNDLES rows
    files = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.col("bytes") / F.sum("bytes").over(every), F.col("n") / F.sum("n").over(every)) * tasks
    files = files.select("part", F.ceil(F.greatest(share, F.col("bytes") / FILE_BYTES)).alias("files"))
    dealt = rows.join(F.broadcast(files), "part").withColumn("file", F.pmod(F.xxhash64("row.doc_id"), "files")).repartition("part", "file").drop("files", "file")
    schema = dealt.drop("part").schema
    dealt.write.partitionBy("part").parquet(path)
    return Layout(spark, schema, shards, [(path, [])])


def reshard(layout: Layout, shards: int, path: str) -> tuple[Layout, dict[str, int]]:
    """The layout with another number of shards, near equal in bytes (law `bytes`), and what it took: bytes moved, the fewest
    possible, files' parts rewritten and bytes in them.

    Groups stay together, so a group larger than a shard's share makes its shard larger than the others, which stay even.
    Only parts with blocks that move are read and written, under `path`; no row is shuffled.
    """
    blocks = layout.sizes()
    where, least = transfers(blocks, layout.shards, shards)
    moved = [k for k, j in where.items() if j != k[0]]
    part = lambda i, b: i * BUNDLES + b * BUNDLES // BLOCKS
    parts = sorted({part(*k) for k in moved})
    inside = [(i, b, part(j, b)) for (i, b), j in where.items() if part(i, b) in set(parts)]
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("shard", "block", "to")])
    rows = layout.read(parts).join(F.broadcast(layout.spark.createDataFrame(inside, schema)), ["shard", "block"])  # shards * BLOCKS rows at most
    rows.withColumn("part", F.col("to")).select(*layout.schema.names, "part").write.partitionBy("part").parquet(path)
    new = Layout(layout.spark, layout.schema, shards, [*((p, sorted({*gone, *parts})) for p, gone in layout.generations), (path, [])])
    return new, {"moved": sum(blocks[k] for k in moved), "least": least, "parts": len(parts), "rewritten": sum(blocks[i, b] for i, b, _ in inside)}


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """rows (doc_id, hash, shard and others, without the text if it need not move) with slot, gapless from 0 in each shard."""
    salts = max(1, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    before = rows.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    ahead = W.Window.partitionBy("shard").orderBy("__cell").rowsBetween(W.Window.unboundedPreceding, -1)  # CELLS rows a shard
    before = before.select("shard", "__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__salt", F.col("__cell") % salts).repartition("shard", "__salt")
    rank = F.row_number().over(W.Window.partitionBy("shard", "__salt", "__cell").orderBy("doc_id", "hash"))
    rows = rows.withColumn("__rank", rank).join(F.broadcast(before), ["shard", "__cell"])  # new_shards * CELLS rows at most
    return rows.withColumn("slot", (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__cell", "__salt", "__rank", "__before")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by bytes, from a layout of 32. A null text has 16 bytes and the group and CRC of the empty text; a null
    doc_id is a row like any other, repeated rows are rows of one group, an empty table gives none. Other columns are left out."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    old = lay_out(docs, F.octet_length(text).cast("long") + 16, text, 32, new_path(spark, "layout"))
    new, _ = reshard(old, 40, new_path(spark, "layout"))
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    rows = numbered(new.read().select("row.doc_id", "size", crc.alias("text_crc32"), "shard", "hash"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
