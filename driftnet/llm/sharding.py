"""Byte-balanced shards by Karmarkar-Karp differencing (operator 3).

Documents of equal text are one indivisible group. Groups are dealt by hash into chunks of bounded size; in each
chunk, differencing joins the partial partitions of largest spread, oppositely ordered, until one is left. The chunks'
partitions are partial partitions themselves and are joined the same way, ``FAN_IN`` at a time, until one is left. A
group of copies is summed on the map side and is one row, however many copies it has.

Defined cases: a null text counts as an empty one, of size 1. Rows with equal doc_id are separate documents. Groups go by the
64-bit hash of the text: equal texts always meet; should two texts share a hash, they share a shard. Extra columns pass
through ``shard_documents``, where shard is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.storage import settle

#: Groups differenced together in a task, and partial partitions joined together in a later one.
CHUNK, FAN_IN = 4096, 1024
#: Documents numbered together in a task.
NUMBERED = 20_000


def karmarkar_karp(partials: list[list[int]]) -> list[list[int]]:
    """For each partial partition (the sums of its slots), the final slot of each of its slots."""
    k = len(partials[0])
    nodes: list[tuple | None] = []
    heap = []
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes.append((None, order))
        top = [sums[j] for j in order]
        heap.append((top[-1] - top[0], i, top))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = sorted(((x[j] + y[k - 1 - j], j) for j in range(k)), reverse=True)
        nodes.append(((a, b), [j for _, j in both]))
        low = both[-1][0]
        top = [s - low for s, _ in both]
        heapq.heappush(heap, (-top[0], len(nodes) - 1, top))
    places: list[list[int] | None] = [None] * len(nodes)
    places[-1] = list(range(k))
    for i in range(len(nodes) - 1, -1, -1):
        children, order = nodes[i]
        at = [0] * k
        for j, old in enumerate(order):
            at[old] = places[i][j]  # the slot before this node's sorting
        if children is None:
            places[i] = at
        else:
            places[children[0]], places[children[1]] = at, at[::-1]
    return places[: len(partials)]


def _difference_groups(k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "g"], ascending=[False, True])
        places = karmarkar_karp([[b] + [0] * (k - 1) for b in rows["bytes"].tolist()])
        return rows.assign(slot=[p[0] for p in places]).astype({"slot": "int32"})[["g", "bytes", "chunk", "slot"]]

    return solve


def _difference_partials(k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="chunk", columns="slot", values="bytes").reindex(columns=range(k)).fillna(0).astype("int64").sort_index()
        places = karmarkar_karp(wide.to_numpy().tolist())
        return pd.DataFrame([(rows["parent"].iloc[0], c, s, t) for c, p in zip(wide.index, places, strict=True) for s, t in enumerate(p)], columns=["parent", "chunk", "slot", "to"])

    return solve


def assign_groups(groups: DataFrame, shards: int = 16) -> DataFrame:
    """(g, shard) for groups (g, bytes)."""
    n = groups.count()
    chunks = max(1, math.ceil(n / CHUNK))
    dealt = groups.withColumn("chunk", F.pmod("g", F.lit(chunks)))
    placed = settle(dealt.groupBy("chunk").applyInPandas(_difference_groups(shards), "g long, bytes long, chunk long, slot int"))
    while chunks > 1:
        chunks_above = math.ceil(chunks / FAN_IN)
        partials = placed.groupBy("chunk", "slot").agg(F.sum("bytes").alias("bytes")).withColumn("parent", F.pmod("chunk", F.lit(chunks_above)))
        moves = partials.groupBy("parent").applyInPandas(_difference_partials(shards), "parent long, chunk long, slot int, to int")
        placed = settle(placed.join(moves, ["chunk", "slot"]).select("g", "bytes", F.col("parent").alias("chunk"), F.col("to").alias("slot")))
        chunks = chunks_above
    return placed.select("g", F.col("slot").alias("shard"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32 and the group g of each document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, g, shard (from 0) and slot (gapless from 0 in each shard), a row for each document."""
    rows = settle(sized(docs))
    placed = rows.join(assign_groups(rows.groupBy("g").agg(F.sum("size").alias("bytes")), shards), "g")
    buckets = max(shards, math.ceil(rows.count() / NUMBERED))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g")))
    slot = (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "g", "shard", slot)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The whole of ``docs`` with its shard; written with ``partitionBy("shard")`` it makes the shards' files."""
    placed = assign_groups(sized(docs).groupBy("g").agg(F.sum("size").alias("bytes")), shards)
    keyed = docs.drop("shard").withColumn("_dn_g", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(placed.withColumnRenamed("g", "_dn_g"), "_dn_g").drop("_dn_g")
