"""Exact deduplication by Grace hash partitioning; equality is decided on complete contents.

1. Each scan task feeds its rows through an open-addressing table of contents. The first row of a
   content becomes a record (with count and top row of its copies in the task), each row keeps the
   number of its record. So a text that makes up a third of all rows leaves a task once. The table is
   flushed when its contents reach ``table_bytes``; a second record of the same content is then merged
   in step 3. Rows and records are written to the shared folder.
2. Records are partitioned by hash. Buckets whose distinct contents exceed ``table_bytes`` are
   partitioned again with another hash, until every bucket fits or holds one hash value. The depth is
   settled on (hash, bytes) statistics first, so texts go through Spark's spill files once.
3. Each bucket is read through one open-addressing table that compares complete contents.
4. Rows join their record's result by record number: at most one task's rows meet in a key.

Defined results: null text is the empty text; texts are compared after lower-casing A-Z alone. A null
doc_id is smaller than any other. Among rows with the same text and the same largest doc_id exactly
one is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import LOWER, UPPER, packed, parts_for, query, table, texts
from chorale.session import settled

TABLE_BYTES = 24 << 20
FANOUT = 16
MAX_DEPTH = 12


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry number, entries hold contents."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def __len__(self):
        return len(self.contents)

    def entry(self, key: int, content: bytes) -> tuple[int, bool]:
        """The entry of ``content``, and whether it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = key & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == key and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content)
        return self.slots[at], True

    def _grow(self):
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


_LOW = -(1 << 63)
_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("row_no", pa.int64()), ("record", pa.int64()), ("content", pa.binary()), ("hash", pa.int64()),
    ("digest", pa.binary()), ("top_id", pa.int64()), ("top_row", pa.int64()), ("copies", pa.int64()),
])


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _records(table_bytes: int):
    """Rows, each with its record; records follow when the table is full and at the end."""

    def scan(batches):
        number = TaskContext.get().partitionId() << 36
        held, digests, tops, counts, first = ContentTable(), [], [], [], number

        def flush():
            n = len(held)
            return pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                pa.array(held.contents, pa.binary()), pa.array([_hash(d) for d in digests], pa.int64()),
                pa.array(digests, pa.binary()), pa.array([t[0] if t[0] > _LOW else None for t in tops], pa.int64()),
                pa.array([t[1] for t in tops], pa.int64()), pa.array(counts, pa.int64()),
            ], schema=_ROWS)

        for batch in batches:
            ids, rows, records = batch.column("doc_id").to_pylist(), [], []
            for doc_id, content in zip(ids, batch.column("content")):
                content = content.as_py().lower()  # of bytes: A-Z alone
                digest = hashlib.sha256(content).digest()
                e, new = held.entry(_hash(digest), content)
                top = (_LOW if doc_id is None else doc_id, number)
                if new:
                    digests.append(digest)
                    tops.append(top)
                    counts.append(1)
                else:
                    tops[e] = max(tops[e], top)
                    counts[e] += 1
                rows.append(number)
                records.append(first + e)
                number += 1
                if held.bytes > table_bytes:
                    yield flush()
                    held, digests, tops, counts, first = ContentTable(), [], [], [], number
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.int64()), pa.array(records, pa.int64())]
                + [pa.nulls(n, f.type) for f in list(_ROWS)[3:]],
                schema=_ROWS,
            )
        if len(held):
            yield flush()

    return scan


def _solved(batches):
    """Buckets arrive one after the other; each is read through a table of its own."""
    held, bucket, records, entries, digests, tops, counts = ContentTable(), None, [], [], [], [], []

    def result():
        top = [tops[e] for e in entries]
        return pa.RecordBatch.from_arrays([
            pa.array(records, pa.int64()), pa.array([t[0] if t[0] > _LOW else None for t in top], pa.int64()),
            pa.array([t[1] for t in top], pa.int64()), pa.array([counts[e] for e in entries], pa.int64()),
            pa.array([digests[e] for e in entries], pa.string()),
        ], names=["record", "keep_id", "keep_row", "group_size", "text_sha256"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "record", "hash", "digest", "top_id", "top_row", "copies")]
        for (b, record, key, digest, top_id, top_row, copies), content in zip(zip(*columns), batch.column("content")):
            if b != bucket:
                if records:
                    yield result()
                held, bucket, records, entries, digests, tops, counts = ContentTable(), b, [], [], [], [], []
            e, new = held.entry(key, content.as_py())
            top = (_LOW if top_id is None else top_id, top_row)
            if new:
                digests.append(digest.hex())
                tops.append(top)
                counts.append(copies)
            else:
                tops[e] = max(tops[e], top)
                counts[e] += copies
            records.append(record)
            entries.append(e)
    if records:
        yield result()


def bucketed(records: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``records`` with ``bucket``: partitioned again where distinct contents exceed ``table_bytes``."""
    sizes = records.select("hash", F.octet_length("content").cast("long").alias("bytes")).groupBy("hash").agg(F.max("bytes").alias("bytes"))
    sizes = settled(sizes, "grace-sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    first = parts_for(total, table_bytes / 4)  # a quarter full on average
    start = F.pmod(F.col("hash"), F.lit(first)).cast("string")
    sizes, records = sizes.withColumn("bucket", start), records.withColumn("bucket", start)
    for depth in range(MAX_DEPTH):
        full = sizes.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > table_bytes) & (F.col("n") > 1))
        full = [r.bucket for r in full.select("bucket").collect()]  # fewer than total / table_bytes names
        if not full:
            break
        over = records.sparkSession.createDataFrame([(b, True) for b in full], "bucket string, over boolean")
        below = F.concat_ws("/", "bucket", F.pmod(F.xxhash64("hash", F.lit(depth)), F.lit(FANOUT)))

        def deeper(frame, over=over, below=below):
            return frame.join(F.broadcast(over), "bucket", "left").withColumn("bucket", F.when(F.col("over"), below).otherwise(F.col("bucket"))).drop("over")

        sizes, records = deeper(sizes), deeper(records)
    return records


def grouped(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    rows = packed(
        texts(docs).select("doc_id", F.col("text").cast("binary").alias("content")).mapInArrow(
            _records(table_bytes),
            "doc_id long, row_no long, record long, content binary, hash long, digest binary, top_id long, top_row long, copies long",
        ),
        "grace-rows",
    )
    records = rows.where(F.col("row_no").isNull()).select("record", "content", "hash", "digest", "top_id", "top_row", "copies")
    solved = (
        bucketed(records, table_bytes)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_solved, "record long, keep_id long, keep_row long, group_size long, text_sha256 string")
    )
    members = rows.where(F.col("row_no").isNotNull()).select("doc_id", "row_no", "record")
    return members.join(solved, "record").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows with one doc_id and different texts are judged apart; an exact repeat of a row stays once.
    """
    kept = grouped(docs, table_bytes).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    body = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), 256)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), body.alias("sha"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")


SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


@query("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, sf_dir):
    return grouped(table(spark, sf_dir, "documents"))
