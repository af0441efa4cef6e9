"""MinHash near-deduplication with bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words, each a 64-bit hash; its sketch is the ``KEPT`` least
of them. The least ``KEPT`` values of two sketches together are a uniform sample of the union, and the share
of it that both have estimates their Jaccard similarity. Linked sets (0.85) fall below an estimate of ``LOWEST``
0.55 with a chance under 1e-10 (Chernoff bound for 96 values; drawing without replacement only lowers it),
so filtering by the estimate loses no link in practice. Sets of up to 96 shingles are their own sketch.

1. **Classes.** One scan gives size, digest and sketch; equal sets form a class and take part once.
2. **Inverted lists.** Retained values of several classes are counted. Linked classes share at least
   T = min(0.85 n, 0.55 * 96) retained values, so a class with fewer is settled, twice over. All but the T - 1
   most frequent are its keys; linked classes share a key. Classes that share keys form loose blocks.
3. **Search.** A task searches blocks of bounded size: a set's key lists give candidates of other components,
   their overlap the estimate of the union sketch, and those that pass are compared on the full sets. First a
   few pivots meet all sets of their block; sets in the block's main component then need no search of their
   own, so a group of near copies costs its size, not its square, and no pair rows are made.
4. **Large blocks** are cut into slices; each slice is searched together with the block's pivots, which joins
   the slices' main components. Only sets outside the block's main component then meet the other slices.

Only a large block whose sets mostly don't link (a chain of shared keys without similarity) costs more than
its size: its unlinked sets meet every slice. Nothing is sampled or capped.

Defined results: words are runs of characters other than blanks, after lower-casing A-Z. With fewer than
five words the whole sequence is the one shingle. Null, empty and blank texts have the empty set, link with
nothing and keep their own doc_id. Rows without doc_id get the component's smallest doc_id, or null, and are not
kept. Repeated rows have equal sets and equal results; all rows with the component's doc_id are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.occurrence_join import shingles
from chorale.llm.registry import hot_join, parts_for, query, table, texts
from chorale.operators.clustering import connected_components
from chorale.session import settled

PERCENT = 85
KEPT = 96
LOWEST = 0.55
BLOCK_TOKENS = 2_000_000
PIVOTS = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)  # fills up the sketches of small sets


def _sets(batches):
    for batch in batches:
        n, sigs, sketches = [], [], []
        for raw in batch.column("content"):
            tokens = shingles(raw.as_py())
            n.append(len(tokens))
            sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            sketches.append(tokens[:KEPT].view(np.int64))
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum([len(s) for s in sketches], out=ends[1:])
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "tag", "n", "sig", "sketch"],
        )


def shared_least(n, percent: int = PERCENT):
    """T: retained values that a set of ``n`` shares with any linked set, for columns and arrays."""
    few, many = (n * percent + 99) // 100 if isinstance(n, np.ndarray) else F.floor((n * percent + 99) / 100), -(-KEPT * int(100 * LOWEST) // 100)
    return np.minimum(few, many) if isinstance(n, np.ndarray) else F.least(few, F.lit(many)).cast("int")


def listed(values: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cls, n, values (the rarest first): classes that share enough of ``values`` (cls, n, value) with others, and those shared."""
    counts = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    total = values.count()
    met = hot_join(values, counts, "value", total)
    lists = met.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values"))  # KEPT values at most
    return lists.where(F.size("values") >= shared_least(F.col("n"), percent)).select("cls", "n", F.col("values.value").alias("values"))


def loose_blocks(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cls, block): classes linked by common keys, directly or by others; a class that shares no key is left out."""
    keys = lists.select("cls", F.explode(F.slice("values", F.lit(1), F.size("values") - shared_least(F.col("n"), percent) + 1)).alias("key"))
    keys = settled(keys, "sketch-keys")
    least = keys.groupBy("key").agg(F.min("cls").alias("least"), F.count("*").alias("times")).where("times > 1")
    edges = hot_join(keys, least, "key", keys.count()).where("cls <> least").select(F.col("cls").alias("u"), F.col("least").alias("v"))
    edges = settled(edges.distinct(), "sketch-edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return connected_components(nodes, edges).select(F.col("node").alias("cls"), F.col("component").alias("block"))


class Search:
    """Links among the sets of one task: enough to span their components."""

    def __init__(self, sets: list[np.ndarray], block: np.ndarray, known: np.ndarray, percent: int):
        """``block`` and ``known``: of each set, its block and its component so far."""
        self.sets, self.block, self.percent = sets, block, percent
        self.n = np.array([len(s) for s in sets], np.int64)
        self.root = np.unique(known, return_inverse=True)[1]
        m = len(sets)
        self.width = np.minimum(self.n, KEPT)
        self.sketch = np.full((m, KEPT), _NONE)
        for i, s in enumerate(sets):
            self.sketch[i, : self.width[i]] = s[:KEPT]
        filled = np.arange(KEPT) < self.width[:, None]
        owner, value = np.nonzero(filled)[0], self.sketch[filled]
        _, self.value, times = np.unique(value, return_inverse=True, return_counts=True)
        order = np.argsort(self.value, kind="stable")
        self.lists, self.list_at = owner[order], np.append(0, np.cumsum(times))
        self.times, self.at = times, np.append(0, np.cumsum(self.width))
        self.keys = self.width - shared_least(self.n, percent) + 1
        self.links: list[tuple[int, int]] = []

    def candidates(self, x: int) -> np.ndarray:
        """Sets of other components and of fitting size in a key list of ``x``."""
        mine = self.value[self.at[x] : self.at[x + 1]]
        rare = mine[np.lexsort((mine, self.times[mine]))][: self.keys[x]]
        rare = rare[self.times[rare] > 1]
        if not len(rare):
            return np.zeros(0, np.int64)
        met = np.concatenate([self.lists[self.list_at[v] : self.list_at[v + 1]] for v in rare])
        met = np.unique(met[self.root[met] != self.root[x]])
        return met[(100 * self.n[met] >= self.percent * self.n[x]) & (100 * self.n[x] >= self.percent * self.n[met])]

    def estimates(self, x: int, ys: np.ndarray) -> np.ndarray:
        """The similarity of ``x`` with each of ``ys``, by the union sketch."""
        mine, theirs = self.sets[x][:KEPT], self.sketch[ys]
        place = np.searchsorted(mine, theirs)
        both = mine[np.minimum(place, len(mine) - 1)] == theirs
        both &= np.arange(KEPT) < self.width[ys][:, None]
        seen = np.cumsum(both, axis=1)
        rank = np.arange(1, KEPT + 1) + place + both - seen  # of their values among both sketches' values
        size = np.minimum(KEPT, len(mine) + self.width[ys] - seen[:, -1])
        return (both & (rank <= KEPT)).sum(1) / size

    def similar(self, x: int, y: int) -> bool:
        small, large = sorted((self.sets[x], self.sets[y]), key=len)
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[place] == small).sum())
        return 100 * both >= self.percent * (len(small) + len(large) - both)

    def compare(self, x: int) -> None:
        """Links of ``x`` to all components it links with."""
        ys = self.candidates(x)
        if len(ys):
            for y in ys[self.estimates(x, ys) >= LOWEST].tolist():
                if self.root[y] != self.root[x] and self.similar(x, y):
                    self.links.append((x, y))
                    self.root[self.root == self.root[y]] = self.root[x]

    def run(self, first: np.ndarray) -> list[tuple[int, int]]:
        """Compares the sets of ``first``, then all that lie outside their block's main component."""
        done = np.zeros(len(self.sets), bool)
        for x in np.flatnonzero(first).tolist():
            self.compare(x)
            done[x] = True
        main = self._main()
        for x in np.flatnonzero(~done).tolist():
            # of two sets in different components one is compared here or above, or both are outside of main
            if self.root[x] != self.root[main[self.block[x]]]:
                self.compare(x)
        return self.links

    def _main(self) -> np.ndarray:
        """For each block a set of its largest component."""
        order = np.lexsort((self.root, self.block))
        b, r = self.block[order], self.root[order]
        edge = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (r[1:] != r[:-1]))))
        size = np.diff(np.append(edge, len(b)))
        out = np.zeros(int(self.block.max()) + 1, np.int64)
        by_size = np.argsort(size, kind="stable")
        out[b[edge[by_size]]] = order[edge[by_size]]
        return out


def _searched(percent: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pivot", "cls"], ascending=[False, True]).drop_duplicates("cls").reset_index(drop=True)
        sets = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
        block = np.unique(frame["block"].to_numpy(), return_inverse=True)[1]
        found = Search(sets, block, frame["known"].to_numpy(), percent).run(frame["pivot"].to_numpy(bool))
        cls = frame["cls"].to_numpy()
        return pd.DataFrame({"u": [cls[a] for a, _ in found], "v": [cls[b] for _, b in found]}, columns=["u", "v"]).astype("int64")

    return search


_MEMBER = ["block", "cls", "known", "pivot", "tokens"]


def _links(units: DataFrame, percent: int) -> DataFrame:
    """Links within each unit; sets marked ``pivot`` are compared with all others."""
    return units.select("unit", *_MEMBER).groupBy("unit").applyInPandas(_searched(percent), "u long, v long")


def links(members: DataFrame, block_tokens: int = BLOCK_TOKENS, percent: int = PERCENT) -> DataFrame:
    """(u, v): links that span the components of ``members`` (block, cls, n, tokens)."""
    loads = members.groupBy("block").agg(F.sum("n").alias("load"))
    total = loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    slices = F.when(F.col("load") > block_tokens, F.ceil(F.col("load") * 2 / block_tokens)).otherwise(1).cast("int")
    loads = loads.select("block", "load", slices.alias("slices"))
    members = hot_join(members, loads.withColumnRenamed("load", "times"), "block", total).withColumnRenamed("times", "load")
    members = members.withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int")).withColumn("known", F.col("cls"))
    members = settled(members, "sketch-members")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("cls"), "cls"))
    pivots = members.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank").withColumn("pivot", F.lit(True))
    bins = parts_for(total, block_tokens / 2)
    of_bin = F.concat(F.lit("bin "), F.pmod(F.xxhash64("block"), F.lit(bins)))
    small = F.col("slices") == 1
    of_slice = F.concat_ws(" ", F.lit("slice"), "block", "slice")
    everyone = members.withColumn("pivot", F.lit(False))
    around = pivots.where(~small).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    units = everyone.unionByName(pivots.where(small)).unionByName(around)
    first = settled(_links(units.withColumn("unit", F.when(small, of_bin).otherwise(of_slice)), percent), "sketch-links")
    if members.where(~small).isEmpty():
        return first

    large = members.where(~small)
    nodes = large.select(F.col("cls").alias("node"))
    known = connected_components(nodes, first.join(nodes, F.col("u") == F.col("node"), "left_semi"))
    large = large.drop("known").join(known.select(F.col("node").alias("cls"), F.col("component").alias("known")), "cls")
    large = settled(large, "sketch-large")
    sizes = large.groupBy("block", "known").agg(F.count("*").alias("size"))
    main = sizes.groupBy("block").agg(F.max(F.struct("size", "known")).alias("main")).select("block", F.col("main.known").alias("main"))
    main = F.broadcast(main)  # a row a large block: fewer than all shingles / block_tokens
    rest = large.join(main, "block").where("known <> main").drop("main")
    loads = rest.groupBy("block").agg(F.ceil(F.sum("n") * 2 / block_tokens).cast("int").alias("parts"))
    loads = F.broadcast(loads)
    rest = rest.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    theirs = large.join(loads, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("pivot", F.lit(False))
    mine = rest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("pivot", F.lit(True))
    units = theirs.unionByName(mine).withColumn("unit", F.concat_ws(" ", "block", "slice", "part"))
    return first.unionByName(settled(_met(units, percent), "sketch-links"))


def _met(units: DataFrame, percent: int) -> DataFrame:
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pivot", "cls"], ascending=[False, True]).drop_duplicates("cls").reset_index(drop=True)
        search = Search([np.frombuffer(t, np.uint64) for t in frame["tokens"]], np.zeros(len(frame), np.int64), frame["known"].to_numpy(), percent)
        for x in np.flatnonzero(frame["pivot"].to_numpy(bool)).tolist():
            search.compare(x)
        cls = frame["cls"].to_numpy()
        return pd.DataFrame({"u": [cls[a] for a, _ in search.links], "v": [cls[b] for _, b in search.links]}, columns=["u", "v"]).astype("int64")

    return units.select("unit", *_MEMBER).groupBy("unit").applyInPandas(meet, "u long, v long")


def _tokens(batches):
    seen = set()  # repeated rows leave a task once
    for batch in batches:
        new = [i for i, cls in enumerate(batch.column("cls").to_pylist()) if not (cls in seen or seen.add(cls))]
        batch = batch.take(pa.array(new, pa.int32()))
        tokens = [shingles(raw.as_py()).tobytes() for raw in batch.column("content")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.binary())], names=["block", "cls", "n", "tokens"])


def deduplicated(docs: DataFrame, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row of ``docs``."""
    tag = F.shiftrightunsigned(F.xxhash64("content"), 33)  # tells texts with one doc_id apart
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("content")).withColumn("tag", tag)
    rows = settled(source.mapInArrow(_sets, "doc_id long, tag long, n long, sig binary, sketch array<long>"), "sketch-sets")
    head = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tag", "n", "sketch")).alias("head")
    full = F.col("n") > 0
    classes = rows.where(full).groupBy("sig").agg(head, F.count("*").alias("times")).select("sig", "times", "head.*")
    classes = settled(classes.withColumn("cls", F.monotonically_increasing_id()), "sketch-classes")  # numbers hold once written
    values = classes.select("cls", "n", F.explode("sketch").alias("value"))
    lists = settled(listed(values, percent), "sketch-lists")
    lists = settled(listed(lists.select("cls", "n", F.explode("values").alias("value")), percent), "sketch-lists")
    chosen = classes.join(loose_blocks(lists, percent), "cls").select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "block", "cls", "n")
    members = source.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).select("block", "cls", "n", "content")
    members = settled(members.mapInArrow(_tokens, "block long, cls long, n long, tokens binary").dropDuplicates(["cls"]), "sketch-tokens")
    found = links(members, block_tokens, percent)
    ends = found.select(F.col("u").alias("node")).union(found.select("v")).distinct()
    linked = connected_components(ends, found).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    named = classes.select("sig", "cls", "times", F.col("doc_id").alias("class_id")).join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(lowest, "root").select("sig", "times", "class_id", "component_id")
    named = settled(named, "sketch-named")
    rows = rows.drop("sketch")
    out = hot_join(rows.where(full), named, "sig", rows.count()).unionByName(rows.where(~full), allowMissingColumns=True)
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


@query("op11_minhash")
def op11_minhash(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
