"""Exact duplicates by an extendible-hash index on shared files.

A text's place is the leading bits of its 64-bit hash. The directory starts as one bucket and is
doubled as long as some bucket is overfull, so every bucket is one range of keys. Tasks first
combine the equal texts of each batch they read, then owner tasks take whole buckets in key order:
entries with one key form a chain, and a chain is told apart by comparing the texts' bytes. A group
of copies reaches its owner as one row per batch read, however large it is. The index (one entry
per different text) lies in the cluster's shared folder and is joined back to the rows.

Defined cases: a NULL text is the empty text. Among equal texts the smallest ``doc_id`` stays; a
NULL id stays only where all ids of the group are NULL. Rows that repeat one id with one text are
copies of one row: they count in ``group_size`` and share ``kept``; ``survivors`` returns one.
Extra columns are carried by ``survivors`` and ignored otherwise. An empty table has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import bits_for, columns_apart, table, tasks, written

#: bytes of different texts in one bucket before it splits
CAPACITY = 32 << 20
#: the directory holds at most 2 ** MAX_DEPTH entries
MAX_DEPTH = 20
#: same text up to white space; matches only stretches that change
_WHITE = r"\x20?[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every stretch of space, tab, line and page breaks as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    body = normalised(F.col("_raw"))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_raw"))
        .select("doc_id", body.alias("body"))
        .withColumn("key", F.xxhash64("body"))
        .withColumn("sha", F.unhex(F.sha2("body", 256)))
    )


def doubled(loads: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int], list[int]]:
    """Directory doubling over the loads of ``2 ** bits`` key ranges.

    Returns the global depth, the bucket of every directory entry and the local depth per bucket.
    A bucket that holds a single range (``bits`` deep) is not split any further.
    """
    tree = [loads.get(i, 0) for i in range(1 << bits)]
    levels = [tree]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
    levels.reverse()  # levels[d][p]: load below the prefix p of d bits
    depth, buckets, todo = 0, [], [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        if levels[local][prefix] > capacity and local < bits:
            if local == depth:
                depth += 1  # the directory doubles
            todo += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((local, prefix))
    entries = [0] * (1 << depth)
    for number, (local, prefix) in enumerate(buckets):
        span = 1 << (depth - local)
        entries[prefix * span:(prefix + 1) * span] = [number] * span
    return depth, entries, [local for local, _ in buckets]


def directory(prints: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Global depth and the directory (``slot``, ``bucket``), from the loads of key ranges. What
    reaches the driver is one count per range, about 16 ranges per bucket and at most 2**20."""
    spark = prints.sparkSession
    keys = prints.groupBy("key").agg(F.max("bytes").alias("bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MAX_DEPTH, bits_for(total / capacity) + 4)
    slot = F.shiftrightunsigned("key", 64 - bits).cast("int").alias("slot")
    loads = {r[0]: r[1] for r in keys.groupBy(slot).agg(F.sum("bytes")).collect()}
    depth, entries, _ = doubled(loads, bits, capacity)
    rows = spark.createDataFrame(
        pa.table({"slot": pa.array(range(len(entries)), pa.int32()),
                  "bucket": pa.array(entries, pa.int32())}))
    return depth, rows


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one batch as one row: bytes are compared by the grouping itself."""
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["bucket", "key", "sha", "body"]).aggregate(
            [("doc_id", "min"), ("doc_id", "count", pc.CountOptions(mode="all"))])
        out = grouped.select(["bucket", "key", "sha", "body", "doc_id_min", "doc_id_count"])
        yield from out.rename_columns(
            ["bucket", "key", "sha", "body", "keep_id", "n"]).combine_chunks().to_batches()


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order; the rows of one key form a chain of different texts."""
    names = ["bucket", "key", "sha", "chain", "keep_id", "group_size"]
    open_key, chain = None, {}

    def closed() -> dict:
        out = {n: [] for n in names}
        for place, (_, (bucket, sha, keep, n)) in enumerate(chain.items()):
            for name, value in zip(names, (bucket, open_key, sha, place, keep, n), strict=True):
                out[name].append(value)
        return out

    kinds = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = pa.schema([
            ("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("chain", pa.int32()),
            ("keep_id", batch.schema.field("keep_id").type), ("group_size", pa.int64())])
        keys = batch.column("key").to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[first[1:], len(keys)]
        lone = ends - first == 1
        lone[0] = lone[-1] = False  # a run at either end may go on in another batch
        alone = batch.take(pa.array(first[lone]))
        yield pa.RecordBatch.from_arrays(
            [alone.column("bucket"), alone.column("key"), alone.column("sha"),
             pa.array(np.zeros(alone.num_rows, np.int32)), alone.column("keep_id"),
             alone.column("n")], schema=kinds)
        for begin, end in zip(first[~lone].tolist(), ends[~lone].tolist(), strict=True):
            if keys[begin] != open_key:
                if chain:
                    yield pa.RecordBatch.from_pydict(closed(), schema=kinds)
                open_key, chain = int(keys[begin]), {}
            for row in batch.slice(begin, end - begin).to_pylist():
                bucket, sha, keep, n = chain.get(
                    row["body"], (row["bucket"], row["sha"], None, 0))
                chain[row["body"]] = (bucket, sha, _smaller(keep, row["keep_id"]), n + row["n"])
    if chain:
        yield pa.RecordBatch.from_pydict(closed(), schema=kinds)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["key", "sha"]).aggregate(
            [("doc_id", "list")])
        yield from grouped.select(["key", "sha", "doc_id_list"]).rename_columns(
            ["key", "sha", "ids"]).combine_chunks().to_batches()


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
          capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index (``bucket key sha chain keep_id group_size``) and the fingerprint of every row
    (``doc_id key sha bytes``), both written to the shared folder."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    full = fingerprints(columns_apart(docs, [doc_id, text]), text, doc_id)
    prints = written(
        full.select("doc_id", "key", "sha", F.octet_length("body").cast("long").alias("bytes")),
        "exact-prints")
    depth, slots = directory(prints, capacity)
    # depth 0 is one bucket: a shift by 64 would be none
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    placed = full.withColumn("slot", slot).join(F.broadcast(slots), "slot").select(
        "bucket", "key", "sha", "body", "doc_id")
    combined = placed.mapInArrow(
        _combine, f"bucket int, key long, sha binary, body string, keep_id {id_type}, n long")
    owned = combined.repartition(tasks(docs.sparkSession), "bucket").sortWithinPartitions("key")
    entries = owned.mapInArrow(
        _own, "bucket int, key long, sha binary, chain int, "
        f"keep_id {id_type}, group_size long")
    return written(entries, "exact-index"), prints


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id keep_id group_size kept text_sha256``."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    index, prints = build(docs, text, doc_id)
    members = prints.select("doc_id", "key", "sha").mapInArrow(
        _members, f"key long, sha binary, ids array<{id_type}>")
    return (
        members.join(index, ["key", "sha"])
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "sha")
        .select("doc_id", "keep_id", "group_size",
                F.expr("doc_id <=> keep_id").alias("kept"),
                F.lower(F.hex("sha")).alias("text_sha256"))
    )


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One whole row of ``docs`` per different text, with all its columns."""
    index, _ = build(docs, text, doc_id)
    body = normalised(F.col(f"`{text}`"))
    # the row goes along as one column, so none of its names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("key"),
                       F.unhex(F.sha2(body, 256)).alias("sha"), F.col(f"`{doc_id}`").alias("id"))
    keep = index.select(F.col("key").alias("k"), F.col("sha").alias("s"), F.col("keep_id").alias("keep"))
    kept = rows.join(keep, (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("keep")))
    return kept.dropDuplicates(["key", "sha", "id"]).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM n JOIN g USING (body)
"""
