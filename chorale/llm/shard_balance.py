"""Shards of near-equal bytes, by Karmarkar-Karp differencing of indivisible groups of equal texts.

1. One scan notes size, checksum and content digest of each row; texts are not shuffled.
2. Group sizes are summed by digest (map-side first, so a hot text leaves each task once).
3. Groups are hashed into parts of about ``per_part`` groups. In each part, the two partial partitions
   with the largest spread are combined again and again, one ordered down, the other up, until one
   partial partition is left: its ``shards`` sums.
4. The parts' partial partitions (one row of ``shards`` sums a part) are combined the same way on the
   driver, and every part gets a permutation of its local labels. The driver sees groups / per_part
   rows, never the groups.
5. Slots number the rows of a shard without gaps: a row number in each (shard, bucket) plus the count
   of earlier buckets, so no task sees a whole shard.

A group larger than a fair share (total / shards) can't lie in one shard of near-equal size. Such a
group alone is dealt, by a hash of doc_id, into pieces of about a sixteenth of a share, and the pieces
are the indivisible items. No other group is split.

Defined results: null text has size 1 and checksum 0 and is equal to the empty text. Rows with the
same doc_id and text are numbered apart. With fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.registry import parts_for, query, table, texts
from chorale.session import settled

PIECES_OF_A_SHARE = 16


def differenced(partials: list[tuple[int, ...]]) -> tuple[list[list[int]], list[int]]:
    """For each partial partition the final label of each of its places; and the final sums."""
    k = len(partials[0])
    nodes: list[tuple[int, int, list[int], list[int]] | None] = [None] * len(partials)
    heap = []
    for i, sums in enumerate(partials):
        heap.append((min(sums) - max(sums), i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        down = sorted(range(k), key=lambda s: (-left[s], s))
        up = sorted(range(k), key=lambda s: (right[s], s))
        sums = tuple(left[x] + right[y] for x, y in zip(down, up))
        nodes.append((a, b, down, up))
        heapq.heappush(heap, (min(sums) - max(sums), len(nodes) - 1, sums))
    _, root, sums = heap[0]
    labels: list[list[int] | None] = [None] * len(nodes)
    labels[root] = list(range(k))
    for i in range(len(nodes) - 1, len(partials) - 1, -1):  # a node comes after its two halves
        a, b, down, up = nodes[i]
        mine = labels[i]
        labels[a], labels[b] = [0] * k, [0] * k
        for place, (x, y) in enumerate(zip(down, up)):
            labels[a][x] = mine[place]
            labels[b][y] = mine[place]
        labels[i] = None
    return labels[: len(partials)], list(sums)


def sharded(docs: DataFrame, shards: int = 8, per_part: int = 20_000, per_bucket: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, group_key, shard, slot of every row of ``docs``."""
    rows = settled(
        texts(docs).select(
            "doc_id",
            (F.octet_length("text").cast("long") + 1).alias("size"),
            F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
            F.sha2("text", 256).alias("group_key"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sizes = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    hot = sizes.where(F.col("group_size") * shards > F.lit(total))  # fewer than ``shards`` rows, by pigeonhole
    pieces = hot.select(
        "group_key", F.ceil(F.col("group_size") * shards * PIECES_OF_A_SHARE / F.lit(max(total, 1))).cast("int").alias("pieces")
    )
    rows = rows.join(F.broadcast(pieces), "group_key", "left").withColumn(
        "piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")
    ).drop("pieces")
    items = rows.groupBy("group_key", "piece").agg(F.sum("size").alias("item_size"))
    parts = parts_for(n, per_part)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group_key", "piece"])  # ties do not depend on the order of arrival
        rest = (0,) * (shards - 1)
        labels, _ = differenced([(int(s), *rest) for s in frame["item_size"]])
        return frame.assign(place=[x[0] for x in labels])[["group_key", "piece", "item_size", "part", "place"]]

    placed = settled(
        items.withColumn("part", F.pmod(F.xxhash64("group_key", "piece"), F.lit(parts)).cast("int"))
        .groupBy("part")
        .applyInPandas(combine, "group_key string, piece int, item_size long, part int, place int"),
        "shard-items",
    )
    sums: dict[int, list[int]] = {}
    for part, place, size in placed.groupBy("part", "place").agg(F.sum("item_size")).collect():  # parts x shards rows
        sums.setdefault(part, [0] * shards)[place] = size
    order = sorted(sums)
    labels = differenced([tuple(sums[p]) for p in order])[0] if order else []
    final = docs.sparkSession.createDataFrame(
        [(p, s, label[s]) for p, label in zip(order, labels) for s in range(shards)], "part int, place int, shard int"
    )
    placed = placed.join(F.broadcast(final), ["part", "place"]).select("group_key", "piece", "shard")
    buckets = parts_for(n, per_bucket)
    out = rows.join(placed, ["group_key", "piece"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    out = settled(out.select("doc_id", "size", "text_crc32", "group_key", "shard", "bucket"), "shard-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return out.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "group_key", "shard", (F.row_number().over(within) - 1 + F.col("offset")).alias("slot")
    )


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
