"""Density clusters of dense vectors, for all sessions in one plan.

A point is core if at least ``min_samples`` other points lie within ``eps``; core points within ``eps`` of each
other form a group, and another point joins the group of its nearest core point within ``eps``.

Points meet in buckets. All points of a session are one bucket, whatever its size, so the result is exact. Only a caller who
gives ``exact_rows`` asks for less: sessions of more distinct points are then cut into ``TABLES`` hash tables of ``BITS``
random projections each, in which two points at distance ``eps`` miss each other with a chance of 1.5 % (and which make one exact bucket
where they separate nothing). No plan or query does. Every meeting is checked by the exact distance.

Equal vectors count as one point with copies. A bucket of more than ``tile_rows`` points is cut into
tiles that share some pivots; only points that are not settled among their own tile and the pivots (no core point yet,
or outside the bucket's main group) meet the other tiles. So a dense group costs its size, not
its square. A task returns at most ``min_samples`` neighbours and one link a point, never pairs. Buckets follow from ``eps``
alone and groups from ``min_samples``, so attempts with other settings share them (``met``, ``grouped``, ``labelled``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale import rules
from chorale.operators.attach import hot_join
from chorale.operators.clustering import _components, connected_components
from chorale.session import settled

TABLES, BITS, WIDTH = 8, 4, 4.0
TILE_ROWS, PIVOTS, BLOCK = 8192, 16, 1024
BUCKET = ["session_id", "bucket"]
UNITS = [*BUCKET, "tile", "part"]


def settings(points: DataFrame, eps: float, size: Column | int = rules.MIN_CLUSTER_SIZE, samples: Column | int = rules.MIN_SAMPLES) -> DataFrame:
    """session_id, eps, min_samples, min_cluster_size of every session; ``size`` and ``samples`` may use the row count ``n``."""
    column = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return points.groupBy("session_id").agg(F.count("*").alias("n")).select(
        "session_id", F.lit(float(eps)).alias("eps"), column(samples).alias("min_samples"), column(size).alias("min_cluster_size")
    )


def bucket_codes(vectors: np.ndarray, eps: np.ndarray, seed: int = 7) -> np.ndarray:
    """The bucket of every vector in each table."""
    rng = np.random.default_rng(seed)
    direction, shift = rng.standard_normal((vectors.shape[1], TABLES * BITS)), rng.random(TABLES * BITS)
    cells = np.floor(vectors @ direction / (WIDTH * eps[:, None]) + shift).astype(np.int64).reshape(-1, TABLES, BITS)
    code = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), cells.shape[:2])
    for b in range(BITS):
        code = (code ^ cells[:, :, b].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code = code ^ (code >> np.uint64(29))
    return code.view(np.int64)


def distinct_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with the ``key`` of their vector, one numbered ``node`` a vector of a session); null vectors are left out."""
    parts = F.struct("session_id", "vector")
    keyed = points.where("vector IS NOT NULL").select(
        "session_id", "item_id", F.col("vector").cast("array<double>").alias("vector"),
        F.concat(F.hex(F.xxhash64(parts)), F.hex(F.hash(parts))).alias("key"),
    )
    nodes = keyed.groupBy("key").agg(
        F.any_value("session_id").alias("session_id"), F.min("item_id").alias("item_id"), F.any_value("vector").alias("vector"),
        F.count("*").alias("times"),
    )
    return keyed.select("session_id", "item_id", "key"), settled(nodes.withColumn("node", F.monotonically_increasing_id()), "density-nodes")


def _by_tables(nodes: DataFrame, exact_rows: int) -> DataFrame:
    """``nodes`` with a row for each ``bucket``: hash tables in sessions of more than ``exact_rows`` nodes."""

    @F.pandas_udf("array<long>")
    def codes(vector: pd.Series, eps: pd.Series) -> pd.Series:
        return pd.Series(list(bucket_codes(np.stack(vector.to_list()), eps.to_numpy()))) if len(vector) else pd.Series([], dtype=object)

    sizes = nodes.groupBy("session_id").agg(F.count("*").alias("points"))
    sized = nodes.join(sizes, "session_id")
    one = F.array(F.lit(0).cast("long"))
    small = sized.where(F.col("points") <= exact_rows).withColumn("buckets", one)
    large = sized.where(F.col("points") > exact_rows).withColumn("buckets", codes("vector", "eps"))
    coded = settled(small.unionByName(large), "density-codes")
    square = lambda n: F.col(n).cast("double") * F.col(n)
    held = coded.select("session_id", "points", F.explode("buckets").alias("bucket")).groupBy(*BUCKET, "points").agg(F.count("*").alias("held"))
    whole = held.groupBy("session_id").agg((F.sum(square("held")) >= F.max(square("points"))).alias("whole"))
    both = coded.join(whole, "session_id").withColumn("bucket", F.explode(F.when(F.col("whole"), one).otherwise(F.col("buckets"))))
    return both.drop("points", "buckets", "whole")


def placed(nodes: DataFrame, exact_rows: int | None, tile_rows: int) -> DataFrame:
    """A row for each bucket of a node that other nodes are in too: session_id, bucket, tile, tiles and the node's columns."""
    both = nodes.withColumn("bucket", F.lit(0).cast("long")) if exact_rows is None else _by_tables(nodes, exact_rows)
    counts = both.groupBy(*BUCKET).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"), F.count("*").alias("in_bucket"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    return settled(both.join(counts.where("in_bucket > 1").drop("in_bucket"), BUCKET).withColumn("tile", tile), "density-placed")


def _own_tiles(rows: DataFrame) -> DataFrame:
    """Every tile with all its rows asking, and the bucket's pivots in each tile."""
    rank = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(F.xxhash64("node"), "node"))
    pivots = rows.where("tiles > 1").withColumn("_rank", rank).where(F.col("_rank") <= PIVOTS).drop("_rank")
    pivots = pivots.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumn("asks", F.lit(True)).unionByName(pivots.withColumn("asks", F.lit(False))).withColumn("part", F.lit(0))


def _other_tiles(rows: DataFrame, rest: DataFrame, tile_rows: int) -> DataFrame:
    """``rest``, asking, with every tile of its bucket."""
    parts = rest.groupBy(*BUCKET).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    theirs = rows.join(parts, BUCKET).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    mine = rest.join(parts, BUCKET).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
    mine = mine.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return theirs.withColumn("asks", F.lit(False)).unionByName(mine.withColumn("asks", F.lit(True)))


def _prepared(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["item_id", "asks"], ascending=[True, False]).drop_duplicates("node").reset_index(drop=True)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    # a tile is much work for few bytes: partitions are not merged by size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *UNITS).groupBy(*UNITS).applyInPandas(run, schema)


def _neighbours(frame: pd.DataFrame) -> pd.DataFrame:
    """Of every asking row some others within eps, min_samples at most; a row that has them meets no further block."""
    names = ["node", "other", "times"]
    frame = _prepared(frame)
    x, asks = np.stack(frame["vector"].to_list()), np.flatnonzero(frame["asks"])
    node, times = frame["node"].to_numpy(), frame["times"].to_numpy()
    eps, k = float(frame["eps"].iloc[0]), int(frame["min_samples"].iloc[0])
    order, have, out = np.random.default_rng(0).permutation(len(frame)), np.zeros(len(frame), int), []
    for at in range(0, len(frame), BLOCK):
        theirs, asks = order[at : at + BLOCK], asks[have[asks] < k]
        for begin in range(0, len(asks), BLOCK):
            mine = asks[begin : begin + BLOCK]
            near = (_squares(x[mine], x[theirs]) <= eps * eps) & (mine[:, None] != theirs[None, :])
            row, place = np.nonzero(near)
            fits = np.arange(len(row)) - np.searchsorted(row, row) < (k - have[mine])[row]
            row, other = row[fits], theirs[place[fits]]
            have[mine] += np.bincount(row, minlength=len(mine))
            out.append(pd.DataFrame({"node": node[mine[row]], "other": node[other], "times": times[other]}))
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names).astype("int64")


def _linked(kind: str):
    """Links of the asking rows: of a core point to a point of its group, of another one to its nearest core point."""
    names = ["node", "other", "distance", "other_item"]

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _prepared(frame)
        x, core, asks = np.stack(frame["vector"].to_list()), frame["core"].to_numpy(bool), frame["asks"].to_numpy(bool)
        node, item, eps = frame["node"].to_numpy(), frame["item_id"].to_numpy(), float(frame["eps"].iloc[0])
        theirs, out = np.flatnonzero(core), []
        for mine, inner in ((np.flatnonzero(asks & core), True), (np.flatnonzero(asks & ~core), False)):
            if not len(mine) or not len(theirs):
                continue
            cuts = [mine[at : at + BLOCK] for at in range(0, len(mine), BLOCK)]
            if inner:
                part = _components(np.concatenate([_squares(x[cut], x[theirs]) <= eps * eps for cut in cuts]))
                ends = np.concatenate([mine, theirs])
                linked = part >= 0
                out.append(pd.DataFrame({"node": node[ends[linked]], "other": node[mine[part[linked]]], "distance": -1.0, "other_item": None}))
            else:
                for cut in cuts:
                    squares = _squares(x[cut], x[theirs])
                    best = squares.argmin(1)
                    least = squares[np.arange(len(cut)), best]
                    found = least <= eps * eps
                    to = theirs[best[found]]
                    out.append(pd.DataFrame({"node": node[cut[found]], "other": node[to], "distance": least[found], "other_item": item[to]}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return link, f"node long, other long, distance double, other_item {kind}"


def neighbours(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(node, other, times): neighbours of every node, min_samples of them or all."""
    schema = "node long, other long, times long"
    first = settled(_by_tile(_own_tiles(rows), _neighbours, schema).distinct(), "density-near")
    cut = rows.where("tiles > 1")
    if cut.isEmpty():
        return first
    enough = _core(rows, first).where("core").select("node")
    rest = cut.join(enough, "node", "left_anti")
    more = _by_tile(_other_tiles(cut, rest, tile_rows), _neighbours, schema)
    return settled(first.unionByName(more).distinct(), "density-near")


def _core(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, core) of every node that has a neighbour or copies."""
    others = found.groupBy("node").agg(F.sum("times").alias("others"))
    each = rows.select("node", "min_samples", F.col("times").alias("own")).distinct()
    known = F.coalesce("others", F.lit(0)) + F.col("own") - 1
    return each.join(others, "node", "left").where(known > 0).select("node", (known >= F.col("min_samples")).alias("core"))


def links(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(node, other, distance, other_item) that connect the groups; ``rows`` of ``placed`` with ``core``."""
    link, schema = _linked(dict(rows.dtypes)["item_id"])
    first = settled(_by_tile(_own_tiles(rows), link, schema), "density-links")
    cut = rows.where("tiles > 1")
    if cut.isEmpty():
        return first
    cores = cut.where("core").select("node").distinct()
    inner = first.where("distance < 0").select(F.col("node").alias("u"), F.col("other").alias("v"))
    group = connected_components(cores, inner.join(cores, F.col("u") == F.col("node"), "left_semi"))
    grouped = cut.join(group, "node", "left")
    sizes = grouped.where("core").groupBy(*BUCKET, "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*BUCKET).agg(F.max(F.struct("n", "component")).getField("component").alias("main"))
    outside = ~F.col("component").eqNullSafe(F.col("main"))  # points that are no core points have no group yet
    rest = grouped.join(main, BUCKET, "left").where(outside).drop("component", "main")
    more = _by_tile(_other_tiles(cut, rest, tile_rows), link, schema)
    return first.unionByName(settled(more, "density-links"))


def met(points: DataFrame, sessions: DataFrame, exact_rows: int | None = None, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points by key, nodes, rows of ``placed``) for the ``eps`` of every session."""
    keyed, nodes = distinct_points(points)
    return keyed, nodes, placed(nodes.join(sessions.select("session_id", "eps"), "session_id"), exact_rows, tile_rows)


def grouped(nodes: DataFrame, rows: DataFrame, sessions: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every node of a group with its ``component``, by the ``min_samples`` of ``sessions``; other sessions are left out."""
    samples = sessions.select("session_id", "min_samples")
    rows = rows.join(samples, "session_id")
    # a vector with copies alone in its session or buckets has no row there
    alone = nodes.where("times > 1").join(samples, "session_id").where("times > min_samples").select("node")
    core = settled(_core(rows, neighbours(rows, tile_rows)), "density-core")
    found = settled(links(rows.join(core, "node"), tile_rows), "density-found")
    cores = core.where("core").select("node").union(alone).distinct()
    inner = found.where("distance < 0").select(F.col("node").alias("u"), F.col("other").alias("v"))
    parts = connected_components(cores, inner)
    nearest = found.where("distance >= 0").groupBy("node").agg(F.min(F.struct("distance", "other_item", "other")).getField("other").alias("other"))
    border = nearest.join(parts.withColumnRenamed("node", "other"), "other").select("node", "component")
    return settled(parts.unionByName(border).join(nodes.select("node", "key", "session_id", "item_id", "times"), "node"), "density-members")


def labelled(points: DataFrame, keyed: DataFrame, member: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, item_id, label) of ``points`` from the groups, by the ``min_cluster_size`` of ``sessions``."""
    groups = member.groupBy("session_id", "component").agg(F.sum("times").alias("size"), F.min("item_id").alias("first"))
    kept = groups.join(sessions, "session_id").where("size >= min_cluster_size")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("size"), "first")) - 1
    named = member.join(kept.select("session_id", "component", number.alias("label")), ["session_id", "component"])
    labels = hot_join(keyed, named.select("key", "times", "label"), "key", points.count()).select("session_id", "item_id", "label")
    return points.select("session_id", "item_id").distinct().join(labels.distinct(), ["session_id", "item_id"], "left").select(
        "session_id", "item_id", F.coalesce("label", F.lit(-1)).alias("label")
    )


def density_clusters(points: DataFrame, sessions: DataFrame, exact_rows: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(session_id, item_id, label) of every point: 0, 1, .. by size, then smallest member; -1 for noise.

    ``points``: session_id, item_id (any type with an order), vector; ``sessions``: see :func:`settings`. Groups with
    fewer than ``min_cluster_size`` points are noise, as are points without a vector.
    """
    keyed, nodes, rows = met(points, sessions, exact_rows, tile_rows)
    return labelled(points, keyed, grouped(nodes, rows, sessions, tile_rows), sessions)
