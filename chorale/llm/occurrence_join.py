"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A document's set is its distinct shingles of five words. Two sets can reach the similarity only if
each has at least T = ceil(similarity * size) shingles in the other, which gives the search three
steps. Each is exact: what it leaves out can't link.

1. **Lists.** Equal sets form a class and take part once. Of every set the shingles with the least
   hashes (about 30 %) go to hash buckets; two linked sets share at least ``c`` of them. Shingles in
   one set only are dropped there, and sets with fewer than ``c`` shared shingles are settled.
2. **Divide.** For the remaining sets the same is done with all shingles and c = T: the T - 1 most
   frequent lists of a set are long, the others short. Linked sets meet in a short list of both.
   Sets that meet in short lists form loose blocks; documents that only share a frequent passage
   don't meet.
3. **Skip.** Each block is searched in numpy: per set, its short lists are merged, candidates that
   could still reach the overlap are counted in the long lists by binary search, and those reaching
   it are linked. Candidates already in the same component are skipped, so a group of near copies
   costs its size, not its square, and no pair rows are made. A block of over ``block_tokens``
   shingles is cut into slices, each pair of slices a task of bounded memory.

Components are the smallest doc_id reachable by links.

Defined results: words are runs of characters other than blanks, after lower-casing A-Z. With fewer
than five words the whole sequence is the one shingle. Null, empty and blank texts have the empty
set, link with nothing and keep their own doc_id. Rows without doc_id get the component's smallest
doc_id, or null. Repeated rows have equal sets. A bucket's memory depends on its distinct shingles:
one with over ``FREQUENT`` sets is passed on as it comes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import parts_for, query, table, texts
from chorale.llm.window_dedup import mixed, runs, word_hashes
from chorale.session import settled

SHINGLE = 5
PERCENT = 80
PER_BUCKET = 1_500_000
BLOCK_TOKENS = 2_000_000
FREQUENT = 1 << 17
TOKENS_AT_ONCE = 400_000


def shingles(raw: bytes, length: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(raw.lower())
    if 0 < len(words) < length:
        return mixed(runs(words, len(words)) + np.uint64(len(words)))
    return np.unique(runs(words, length))


def needed(n, percent: int = PERCENT):
    """T: the least overlap with any linked set."""
    return -(-n * percent // 100)


def hash_prefix(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(p, c): linked sets share at least c of the p least hashes of either."""
    extra = needed(n, percent) // 10 + 1
    widest = n // 10 + 1
    return min(n, n - needed(n, percent) + widest), extra


_SETS = "doc_id long, tag long, n long, sig binary, cls long"


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _cls(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _sets(batches):
    for batch in batches:
        n, sigs = [], []
        for raw in batch.column("content"):
            tokens = shingles(raw.as_py())
            n.append(len(tokens))
            sigs.append(_signature(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(map(_cls, sigs), pa.int64())],
            names=["doc_id", "tag", "n", "sig", "cls"],
        )


def _dealt(buckets: int, pieces):
    """Rows (bucket, hashes, classes) of the (class, tokens) that ``pieces`` draws from the batches."""

    def packed(held):
        tokens = np.concatenate([t for _, t in held])
        owners = np.repeat(np.array([c for c, _ in held], np.int64), [len(t) for _, t in held])
        bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, owners, bucket = tokens[order], owners[order], bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() + [len(bucket)]
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[edges[:-1]]), pa.array([tokens[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
            pa.array([owners[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
        ], names=["bucket", "hashes", "classes"])

    def deal(batches):
        held, size = [], 0
        for one in pieces(batches):
            held.append(one)
            size += len(one[1])
            if size >= TOKENS_AT_ONCE:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return deal


def _prefixes(batches):
    seen = set()  # classes this task has dealt out: copies are dealt once
    for batch in batches:
        for raw in batch.column("content"):
            tokens = shingles(raw.as_py())
            if len(tokens):
                cls = _cls(_signature(tokens))
                if cls not in seen:
                    seen.add(cls)
                    yield cls, tokens[: hash_prefix(len(tokens))[0]]


def _whole_sets(batches):
    for batch in batches:
        for cls, raw in zip(batch.column("cls").to_pylist(), batch.column("tokens")):
            yield cls, np.frombuffer(raw.as_py(), np.uint64)


def _counted(hashes, classes, frequent):
    """(hashes, classes, sets with the hash) of distinct rows; frequent hashes have FREQUENT."""
    order = np.lexsort((classes, hashes))
    h, c = hashes[order], classes[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        h, c = h[new], c[new]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    df = np.minimum(np.repeat(times, times), FREQUENT)
    df[np.isin(h, frequent)] = FREQUENT
    return h, c, df


def _by_class(h, c, df, parts):
    """Shared shingles as rows (part, classes, hashes, df), packed by parts of the classes."""
    keep = df > 1
    h, c, df = h[keep], c[keep], df[keep].astype(np.int32)
    part = ((c.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    h, c, df, part = h[order], c[order], df[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() + [len(part)] if len(part) else [0]
    spans = list(zip(edges, edges[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[edges[:-1]])] + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (c, h, df)],
        names=["part", "classes", "hashes", "df"],
    )


def _shared(parts: int):
    """Rows (part, classes, hashes, df) of the shingles that several classes have; one bucket after the other."""

    def share(batches):
        bucket, hashes, classes, size, frequent = None, [], [], 0, np.zeros(0, np.uint64)

        def done():
            return _by_class(*_counted(np.concatenate(hashes), np.concatenate(classes), frequent), parts)

        for batch in batches:
            for b, h, c in zip(batch.column("bucket").to_pylist(), batch.column("hashes"), batch.column("classes")):
                if b != bucket:
                    if hashes:
                        yield done()
                    bucket, hashes, classes, size, frequent = b, [], [], 0, np.zeros(0, np.uint64)
                hashes.append(np.frombuffer(h.as_py(), np.uint64))
                classes.append(np.frombuffer(c.as_py(), np.int64))
                size += len(hashes[-1])
                if size > 2 * PER_BUCKET:  # hashes of very many sets must not fill the memory: pass them on
                    h, c, df = _counted(np.concatenate(hashes), np.concatenate(classes), frequent)
                    over = df >= FREQUENT
                    if over.any():
                        yield _by_class(h[over], c[over], df[over], parts)
                        frequent = np.union1d(frequent, h[over])
                    hashes, classes = [h[~over]], [c[~over]]
                    size = min(len(hashes[0]), PER_BUCKET)
        if hashes:
            yield done()

    return share


def _gathered(batches):
    """(cls, hashes): the shared shingles of a class, the rarest first; rows arrive by part of the classes."""
    part, held = None, ([], [], [])

    def done():
        c, h, d = (np.concatenate(x) for x in held)
        order = np.lexsort((h, d, c))
        c, h = c[order], h[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])))  # a frequent one may come from two tasks
        c, h = c[new], h[new]
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(c[first]), lists], names=["cls", "hashes"])

    for batch in batches:
        for p, c, h, d in zip(batch.column("part").to_pylist(), batch.column("classes"), batch.column("hashes"), batch.column("df")):
            if p != part:
                if held[0]:
                    yield done()
                part, held = p, ([], [], [])
            for into, raw, kind in zip(held, (c, h, d), (np.int64, np.uint64, np.int32)):
                into.append(np.frombuffer(raw.as_py(), kind))
    if held[0]:
        yield done()


def short_lists(dealt: DataFrame, sizes: DataFrame, least, parts: int) -> DataFrame:
    """(cls, keys): classes with at least ``least(n)`` shared shingles, and those but the least(n) - 1 most frequent."""
    shared = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _shared(parts), "part int, classes binary, hashes binary, df binary"
    )
    lists = shared.repartition("part").sortWithinPartitions("part").mapInArrow(_gathered, "cls long, hashes array<long>")
    c = least(F.col("n"))
    return lists.join(sizes, "cls").where(F.size("hashes") >= c).select(
        "cls", F.slice("hashes", F.lit(1), (F.size("hashes") - c + 1).cast("int")).alias("keys")
    )


class Sets:
    """The sets of a block with their inverted lists."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
        self.df = np.sort(df)  # by rank: the rarest first
        owner = np.repeat(np.arange(len(sets)), self.n)
        ranked = rank[token]
        order = np.lexsort((ranked, owner))
        self.tokens, self.at = ranked[order], np.append(0, np.cumsum(self.n))
        self.lists, self.list_at = self._inverted(np.ones(len(sets), bool))

    def _inverted(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(self.n)), self.n)
        keep = among[owner]
        token, owner = self.tokens[keep], owner[keep]
        order = np.argsort(token, kind="stable")
        return owner[order], np.append(0, np.cumsum(np.bincount(token, minlength=len(self.df))))

    def of(self, x: int) -> np.ndarray:
        return self.tokens[self.at[x] : self.at[x + 1]]

    def links(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that span the components; with ``side``, only sets of different sides are compared."""
        m = len(self.n)
        root, out = np.arange(m), []
        lists, list_at, outside, rebuild = self.lists, self.list_at, None, 2
        for x in range(m):
            if x == rebuild:  # of the sets in the largest component only links to others are of interest
                rebuild *= 2
                big = np.bincount(root).argmax()
                outside = root != big
                lists, list_at = self._inverted(outside)
            if outside is not None and not outside[x]:
                if not len(lists):
                    continue
                use, use_at = lists, list_at
            else:
                use, use_at = self.lists, self.list_at
            mine, n = self.of(x), self.n[x]
            least = -(-n * self.percent // 100)
            short = mine[: n - least + 1]
            short = short[self.df[short] > 1]
            if not len(short):
                continue
            merged = np.concatenate([use[use_at[t] : use_at[t + 1]] for t in short])
            fits = (root[merged] != root[x]) & (100 * self.n[merged] >= self.percent * n) & (100 * n >= self.percent * self.n[merged])
            if side is not None:
                fits &= side[merged] != side[x]
            found, times = np.unique(merged[fits], return_counts=True)
            long = mine[n - least + 1 :]
            for y, count in zip(found.tolist(), times.tolist()):
                if root[y] == root[x]:
                    continue  # joined meanwhile
                enough = -(-self.percent * (n + self.n[y]) // (100 + self.percent))
                if count + len(long) < enough:
                    continue
                theirs = self.of(y)
                place = np.searchsorted(theirs, long)  # binary probes of the long lists
                place[place == len(theirs)] = len(theirs) - 1
                if count + int((theirs[place] == long).sum()) >= enough:
                    out.append((x, y))
                    root[root == root[y]] = root[x]
        return out


def _searched(percent: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sig").drop_duplicates("sig").reset_index(drop=True)
        sets = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
        side = frame["side"].to_numpy() if frame["side"].nunique() > 1 else None
        links = Sets(sets, percent).links(side)
        return pd.DataFrame({"u": [frame["sig"][a] for a, _ in links], "v": [frame["sig"][b] for _, b in links]}, columns=["u", "v"])

    return search


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every component of (u, v), for nodes with a link."""
    from chorale.operators.clustering import connected_components

    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return connected_components(nodes, edges).select("node", F.col("component").alias("root"))


def joined(docs: DataFrame, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, tag, n_shingles, class_id, component_id, root, first of every row of ``docs``.

    ``root`` names the component (null for empty sets); ``first`` says whether (doc_id, tag) is its first text.
    """
    tag = F.shiftrightunsigned(F.xxhash64("content"), 33)
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("content")).withColumn("tag", tag)
    rows = settled(source.mapInArrow(_sets, _SETS), "shingle-sets")
    classes = rows.where("n > 0").groupBy("sig", "cls", "n").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tag")).alias("first"))
    classes = settled(classes.select("sig", "cls", "n", "first.doc_id", "first.tag"), "shingle-classes")
    sizes = classes.groupBy("cls").agg(F.min("n").alias("n"))

    def t(n):
        return F.floor((n * percent + 99) / 100).cast("int")

    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = parts_for(0.3 * total, PER_BUCKET)
    first = short_lists(
        source.mapInArrow(_dealt(parts, _prefixes), "bucket int, hashes binary, classes binary"),
        sizes, lambda n: F.floor(t(n) / 10).cast("int") + 1, parts,
    ).select("cls")
    first = settled(classes.join(first, "cls", "left_semi"), "shingle-first")
    chosen = first.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "sig", "cls", "n")
    near = source.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).select("sig", "cls", "n", "content")
    near = settled(near.mapInArrow(_tokens, "sig binary, cls long, n long, tokens binary").dropDuplicates(["sig"]), "shingle-near")
    some = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = parts_for(some, PER_BUCKET)
    dealt = near.select("cls", "tokens").mapInArrow(_dealt(parts, _whole_sets), "bucket int, hashes binary, classes binary")
    keys = settled(short_lists(dealt, sizes, t, parts), "shingle-keys")
    lists = keys.select("cls", F.explode("keys").alias("key"))
    least = lists.groupBy("key").agg(F.min("cls").alias("v"))
    loose = components(settled(lists.join(least, "key").where("cls <> v").select(F.col("cls").alias("u"), "v").distinct(), "shingle-loose"))
    members = near.join(loose.select(F.col("node").alias("cls"), "root"), "cls")
    blocks = members.groupBy("root").agg(F.sum("n").alias("load"))
    bins = parts_for(some, block_tokens / 2)
    large = F.ceil(F.col("load") * 2 / block_tokens).cast("int")
    blocks = blocks.withColumn("slices", F.when(F.col("load") > block_tokens, large).otherwise(1))
    placed = members.join(blocks, "root").withColumn("slice", F.pmod(F.xxhash64("sig"), F.col("slices")).cast("int"))
    unit = F.when(F.col("slices") == 1, F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins)))).otherwise(
        F.concat_ws(" ", F.lit("pair"), "root", F.least("slice", "other"), F.greatest("slice", "other"))
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        unit.alias("unit"), F.when(F.col("slice") == F.col("other"), 0).otherwise(F.when(F.col("slice") < F.col("other"), 1).otherwise(2)).alias("side"),
        "sig", "tokens",
    )
    links = settled(placed.groupBy("unit").applyInPandas(_searched(percent), "u binary, v binary"), "shingle-links")
    linked = components(links.select(F.hex("u").alias("u"), F.hex("v").alias("v")))
    named = classes.select("sig", F.col("doc_id").alias("class_id"), F.col("tag").alias("class_tag"), F.hex("sig").alias("node"))
    named = named.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(
        F.min("class_id").alias("component_id"), F.min(F.struct(F.isnull("class_id").alias("no_id"), "class_id", "class_tag")).alias("head")
    )
    named = named.join(heads, "root").select("sig", "class_id", "component_id", "root", "head")
    return rows.join(named, "sig", "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "root",
        F.coalesce(F.col("head.class_id").eqNullSafe(F.col("doc_id")) & (F.col("head.class_tag") == F.col("tag")), F.lit(False)).alias("first"),
    )


def _tokens(batches):
    for batch in batches:
        tokens = [shingles(raw.as_py()).tobytes() for raw in batch.column("content")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sig"), batch.column("cls"), batch.column("n"), pa.array(tokens, pa.binary())], names=["sig", "cls", "n", "tokens"]
        )


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, its smallest doc_id, with the columns of ``docs``; texts without words stay.

    An exact repeat of a row stays once.
    """
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = joined(docs, percent).where("first").select(F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag")).distinct()
    tag = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("binary")), 33)
    keyed = docs.where(words).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), tag.alias("tag"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag"))
    kept = keyed.join(first, same, "left_semi").dropDuplicates(["id", "tag"])
    return kept.select("row.*").unionAll(docs.where(~words))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark, sf_dir):
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
