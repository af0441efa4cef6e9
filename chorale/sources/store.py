"""Stored tables whose rows are replaced by key: hash buckets, and a manifest that is switched last.

``<path>/data/part=<name>/store_version=<n>/store_bucket=<b>`` holds rows; a row's bucket is a hash of its first key
column, so the number of folders depends on the number of buckets and kept versions, never on the number of sessions.
``<path>/manifest/store_version=<n>`` is one small file: for every part its schema and the version that each
bucket is read from. A commit writes the rows of the touched buckets first, of all parts, and the manifest
last; a reader sees the old version of every part or the new one. A commit that died leaves files no manifest
names, and its repetition writes over them. One writer a path at a time.

The schema comes from the manifest: no footers are opened to merge schemas, and a column that older files lack
reads as null. A column keeps its type; a commit that changes it is refused. A null key is a key like any other.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from chorale.operators.ranking import latest
from chorale.session import settled

BUCKETS = 64
BUCKET, VERSION = "store_bucket", "store_version"
MANIFEST = "part string, buckets int, keys array<string>, format string, schema string, versions array<bigint>"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, Row]]:
    """(newest version, its entry per part); (0, {}) where nothing was committed yet."""
    try:
        table = spark.read.schema(f"{MANIFEST}, {VERSION} bigint").json(f"{path}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0, {}
    newest = table.agg(F.max(VERSION)).first()[0]
    if newest is None:
        return 0, {}
    return newest, {r["part"]: r for r in table.where(F.col(VERSION) == newest).collect()}


def _rows(spark: SparkSession, path: str, entry: Row) -> DataFrame:
    """Live rows of a part with their bucket; folders of other versions are pruned before any file is listed as input."""
    schema = T.StructType.fromJson(json.loads(entry["schema"])).add(VERSION, T.LongType()).add(BUCKET, T.IntegerType())
    table = spark.read.schema(schema).format(entry["format"]).load(f"{path}/data/part={entry['part']}")
    versions = F.array(*[F.lit(v).cast("bigint") for v in entry["versions"]])
    return table.where(F.col(VERSION) == F.element_at(versions, F.col(BUCKET) + 1)).drop(VERSION)


def read(spark: SparkSession, path: str, part: str = "rows", **key: str) -> DataFrame:
    """The committed rows of a part; with a value of its first key column, given by name, only that bucket is read."""
    entry = manifest(spark, path)[1].get(part)
    if entry is None:
        raise FileNotFoundError(f"PART_NOT_FOUND: {path}/{part}")
    rows = _rows(spark, path, entry)
    if key:
        first = entry["keys"][0]
        if list(key) != [first]:
            raise ValueError(f"{part} is stored by {first}")
        rows = rows.where((F.col(BUCKET) == bucket_of(F.lit(key[first]), entry["buckets"])) & (F.col(first) == F.lit(key[first])))
    return rows.drop(BUCKET)


def _merged_schema(old: T.StructType, new: T.StructType, part: str) -> T.StructType:
    known = {f.name: f.dataType for f in old}
    for field in new:
        # simpleString leaves out nullability, which files don't keep
        if field.name in known and known[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(f"STORE_TYPE_CHANGED: {part}.{field.name}")
    fields = [*old, *[f for f in new if f.name not in known]]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def _write(path: str, number: int, part: str, new: DataFrame, entry: Row | None, keys, order, buckets, fmt, cleared) -> tuple:
    """Write the touched buckets of a part; its manifest entry. Buckets are as many as at the first commit."""
    spark = new.sparkSession
    if entry is not None:
        keys, buckets, fmt = entry["keys"], entry["buckets"], entry["format"]
    if {BUCKET, VERSION} & set(new.columns):
        raise ValueError(f"{BUCKET} and {VERSION} are the store's own columns")
    mark = lambda df: df.withColumn(BUCKET, bucket_of(F.col(keys[0]), buckets))
    rows = settled(mark(new), f"commit-{part}")
    replaced = rows.select(*keys, BUCKET)
    if cleared is not None:
        replaced = replaced.unionByName(mark(cleared.select(*keys)))
    # a table of its own, so that its size is known: few keys are broadcast, and no stored row is shuffled by key
    replaced = settled(replaced.distinct(), f"replaced-{part}")
    touched = [r[0] for r in replaced.select(BUCKET).distinct().collect()]  # at most as many as buckets
    schema = _merged_schema(T.StructType([]) if entry is None else T.StructType.fromJson(json.loads(entry["schema"])), new.schema, part)
    versions = [0] * buckets if entry is None else list(entry["versions"])
    if entry is not None and touched:
        current = _rows(spark, path, entry).where(F.col(BUCKET).isin(touched))
        if order:
            rows = current.unionByName(rows, allowMissingColumns=True)
        else:
            same = reduce(Column.__and__, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
            rest = current.alias("c").join(replaced.alias("n"), same, "left_anti")
            rows = rest.unionByName(rows, allowMissingColumns=True)
    if order:
        rows = latest(rows, keys, order)
    for bucket in touched:
        versions[bucket] = number
    # rebalance: a bucket with a hot key becomes many files, small ones one
    rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).format(fmt).save(
        f"{path}/data/part={part}/{VERSION}={number}"
    )
    return part, buckets, keys, fmt, schema.json(), versions


def commit(
    path: str, parts: dict[str, DataFrame], keys: list[str], order: str | None = None, buckets: int = BUCKETS,
    fmt: str = "parquet", cleared: dict[str, DataFrame] | None = None,
) -> int:
    """Store new rows of some parts as one new version; the other parts and keys stay. Returns the version.

    Without ``order`` the rows of every key that occurs replace all stored rows of that key; keys of ``cleared``
    lose theirs too. With ``order`` rows are items: of equal ``keys`` the one with the largest ``order`` stays.
    Either way a repeated commit leaves the same rows.
    """
    spark = next(iter(parts.values())).sparkSession
    before, entries = manifest(spark, path)
    number = before + 1
    done = [
        _write(path, number, part, rows, entries.get(part), keys, order, buckets, fmt, (cleared or {}).get(part))
        for part, rows in parts.items()
    ]
    kept = [tuple(entries[p][f] for f in ("part", "buckets", "keys", "format", "schema", "versions")) for p in entries if p not in parts]
    spark.createDataFrame(done + kept, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{VERSION}={number}")
    return number


def drop_superseded(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove versions that none of the newest ``keep`` manifests reads, and older manifests; the removed folders.

    Plans made from the kept manifests stay readable. What a commit that died left behind goes too.
    """
    newest, _ = manifest(spark, path)
    if newest == 0:
        return []
    table = spark.read.schema(f"{MANIFEST}, {VERSION} bigint").json(f"{path}/manifest")
    first = newest - keep + 1
    live = table.where(F.col(VERSION) >= first).select("part", F.explode("versions").alias("v")).distinct()
    wanted = {(r["part"], r["v"]) for r in live.collect()}
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    removed = []
    for pattern in (f"data/part=*/{VERSION}=*", f"manifest/{VERSION}=*"):
        for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, pattern)):
            found = status.getPath()
            part, number = found.getParent().getName().removeprefix("part="), int(found.getName().split("=")[1])
            old = number < first if part == "manifest" else (part, number) not in wanted
            if old:
                files.delete(found, True)
                removed.append(found.toString())
    return removed
