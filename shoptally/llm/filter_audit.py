"""How document filters act upon each other, in every order of application.

The word counts of all documents form a sparse document-term matrix. A pass over the texts cuts them
into shards of bounded size and numbers the words of each. The words of all shards, each once per
shard, are dealt out by hash and get dense numbers (the dictionary); these go back to the shards, whose
columns are renamed. A shard is then one row in CSR form: row ends, column numbers, counts. Row sums
and nonzero counts of the matrix decide the filters on words; character measures and a digest of each
text come from the same pass, and the smallest id per digest decides the filter on copies.

What a filter order does to a part depends only on how many documents fail which set of filters, so
documents are counted by part and set (at most 32 sets), and the orders are evaluated on the counts.

Defined cases: a NULL text is empty: it fails A (no words) and none of B, C and D. A NULL id is not
smaller than any and none is smaller than it, so it neither fails E nor makes others fail. Rows that
repeat an id count each. Several labels of one id: one that says 1 is enough; labels of no document
or of no id are ignored. A NULL part is the empty string. Extra columns are ignored. An empty table
has no parts and gives no rows. Of tied rows (same id, same text) none is smaller: both pass E.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoptally.llm.common import salted, table, tasks, written

#: characters of text in one shard, about; a text is never divided
SHARD_CHARS = 12 << 20
#: bytes of text a task turns into words at a time
_SLICE = 1 << 20
FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = b"#$%&*|"

_MEASURES = "points bigint, upper bigint, marked boolean, digest binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def compressed(rows: list[list[bytes]], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word lists in CSR form: nonzeros per row, columns by ``numbers``, counts."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    found = np.fromiter(map(numbers.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
    width = max(1, len(numbers))
    cells, counts = np.unique(np.repeat(np.arange(len(rows)), sizes) * width + found, return_counts=True)
    filled = np.bincount(cells // width, minlength=len(rows))
    return filled, (cells % width).astype(np.int32), counts.astype(np.int32)


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARKED = np.zeros(256, bool)
_MARKED[list(MARKS)] = True


def measures(texts: list[str], raw: list[bytes]) -> pa.StructArray:
    """Code points, letters A to Z, whether a mark occurs, and the digest, per text."""
    upper, marked = [], []
    for body in raw:
        data = np.frombuffer(body, np.uint8)
        upper.append(int(np.count_nonzero(_UPPER[data])))
        marked.append(bool(_MARKED[data].any()))
    return pa.StructArray.from_arrays(
        [pa.array(list(map(len, texts)), pa.int64()), pa.array(upper, pa.int64()), pa.array(marked, pa.bool_()),
         pa.array([hashlib.sha256(b).digest() for b in raw], pa.binary())],
        names=["points", "upper", "marked", "digest"])


class _Shard:
    """The rows of one shard as they come."""

    def __init__(self):
        self.numbers, self.size = _Numbers(), 0
        self.filled, self.columns, self.counts, self.docs = [], [], [], []

    def add(self, kept: pa.Array, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        for place, part in zip((self.filled, self.columns, self.counts),
                               compressed([r.split() for r in raw], self.numbers), strict=True):
            place.append(part)
        self.docs.append(pa.StructArray.from_arrays(
            [kept, *measures(texts, raw).flatten()], names=["kept", "points", "upper", "marked", "digest"]))
        self.size += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        docs = pa.concat_arrays(self.docs)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.filled), dtype=np.int64)])
        columns, counts = np.concatenate(self.columns), np.concatenate(self.counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
             pa.array([ends.tobytes()], pa.binary()), pa.array([columns.tobytes()], pa.binary()),
             pa.array([counts.tobytes()], pa.binary()), pa.array([list(self.numbers)], pa.list_(pa.binary()))],
            names=["shard", "docs", "ends", "columns", "counts", "words"])


def _cut(limit: int):
    """Batches of (``kept``, ``body``) as shards with columns of their own numbering."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, _Shard()
        for batch in batches:
            kept, body = batch.column("kept"), batch.column("body")
            sizes = pc.binary_length(body).to_numpy(zero_copy_only=False)
            for begin, end in slices(sizes, _SLICE):
                held.add(kept.slice(begin, end - begin), body.slice(begin, end - begin).to_pylist())
                if held.size >= limit:
                    yield held.row(number)
                    number, held = number + 1, _Shard()
        if held.docs:
            yield held.row(number)

    return cut


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``limit`` bytes each; a longer row stands alone."""
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words come sorted: each different one gets the next number and is given out once."""
    part, number, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        words = batch.column("word")
        if not len(words):
            continue
        new = np.concatenate([[words[0].as_py() != last], pc.not_equal(words[1:], words[:-1]).to_numpy(
            zero_copy_only=False).astype(bool)])
        numbers = number + np.cumsum(new)
        number, last = int(numbers[-1]), words[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("at"), pa.array(np.full(len(words), part, np.int32)),
             pa.array(numbers, pa.int64()), pc.if_else(pa.array(new), words, pa.scalar(None, pa.binary()))],
            names=["shard", "at", "part", "number", "word"])


def _renamed(own: pa.Table, ids: pa.Table) -> pa.Table:
    """A shard's columns become the dictionary's."""
    for_at = np.zeros(ids.num_rows, np.int64)
    for_at[ids.column("at").to_numpy()] = ids.column("id").to_numpy()
    columns = [for_at[np.frombuffer(c.as_buffer(), np.int32)].tobytes() for c in own.column("columns")]
    return own.set_column(own.schema.get_field_index("columns"), "columns", pa.array(columns, pa.binary()))


def shards(docs: DataFrame, kept: list[Column], text: str = "text", limit: int = SHARD_CHARS) -> DataFrame:
    """Written shards: ``shard docs ends columns counts words``, columns by the shard's own numbers.
    ``docs`` holds ``kept`` and the measures of each document, in row order."""
    source = docs.select(F.struct(*kept).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    fields = source.schema["kept"].dataType.simpleString()
    return written(source.mapInArrow(_cut(limit), (
        f"shard bigint, docs array<struct<kept: {fields}, points: bigint, upper: bigint, marked: boolean, "
        "digest: binary>>, ends binary, columns binary, counts binary, words array<binary>")), "audit-shards")


def numbering(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (``word id``, ids dense) and the ids of every shard's own words (``shard at id``).

    Each shard hands in each of its words once, so no word is hot beyond the number of shards. Words
    are dealt out by hash and numbered in order within a partition; the partitions' totals, one row
    each, are summed up to the place where each begins.
    """
    spark = parts.sparkSession
    own = parts.select("shard", F.posexplode("words").alias("at", "word"))
    entries = written(
        own.repartition(tasks(spark), "word").sortWithinPartitions("word").mapInArrow(
            _numbered, "shard bigint, at int, part int, number bigint, word binary"), "audit-words")
    totals = entries.groupBy("part").agg((F.max("number") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = entries.join(F.broadcast(begins), "part").withColumn("id", F.col("begin") + F.col("number"))
    return placed.where(F.col("word").isNotNull()).select("word", "id"), placed.select("shard", "at", "id")


def _together(docs: DataFrame, kept: list[Column], text: str, limit: int):
    parts = shards(docs, kept, text, limit)
    names, ids = numbering(parts)
    own = parts.drop("words")
    return own, own.groupBy("shard").cogroup(ids.groupBy("shard")), names


def matrix(docs: DataFrame, kept: list[Column], text: str = "text",
           limit: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix, one CSR shard a row, and its dictionary.

    Shards: ``shard docs ends columns counts``; ``ends`` (64-bit, with a leading 0), ``columns``
    (64-bit, numbers of the dictionary) and ``counts`` (32-bit) are little-endian.
    """
    own, both, names = _together(docs, kept, text, limit)
    return both.applyInArrow(_renamed, own.schema), names


def _sums(own: pa.Table, ids: pa.Table) -> pa.Table:
    """Row sums and nonzero counts of one shard of the matrix."""
    csr = _renamed(own, ids).combine_chunks().to_batches()[0]
    ends, counts, columns = (
        np.frombuffer(csr.column(c)[0].as_buffer(), kind)
        for c, kind in (("ends", np.int64), ("counts", np.int32), ("columns", np.int64)))
    if len(columns) != ends[-1]:
        raise ValueError("a shard's columns and rows do not fit together")
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return pa.Table.from_arrays(
        [*csr.column("docs").flatten().flatten(), pa.array(upto[ends[1:]] - upto[ends[:-1]]), pa.array(np.diff(ends))],
        names=["kept", "points", "upper", "marked", "digest", "words", "distinct"])


def row_statistics(docs: DataFrame, kept: list[Column], text: str = "text", limit: int = SHARD_CHARS) -> DataFrame:
    """One row per document: ``kept``, its measures, ``words`` (row sum of the matrix) and ``distinct``
    (nonzeros), taken where a shard gets its columns, so the matrix itself is not moved again."""
    own, both, _ = _together(docs, kept, text, limit)
    fields = own.schema["docs"].dataType.elementType["kept"].dataType.simpleString()
    return both.applyInArrow(_sums, StructType.fromDDL(f"kept {fields}, {_MEASURES}, words bigint, distinct bigint"))


def failures(docs: DataFrame, part: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``part doc_id failed`` and its statistics; bit ``i`` of ``failed`` is
    set if filter ``FILTERS[i]`` would remove it."""
    seen = row_statistics(docs, [part.alias("part"), F.col(doc_id).alias("doc_id")], text)
    rows = written(
        seen.select("kept.part", "kept.doc_id", "points", "upper", "marked", "digest",
                                   "words", "distinct", F.monotonically_increasing_id().alias("row")),
        "audit-rows")
    # a text that occurs once has no copy: only repeated ones are joined back
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    joined = salted(rows, firsts.where("n > 1").drop("n"), ["digest"], F.col("row"), "left", broadcast=False)
    fails = {
        "A": F.col("words") < MIN_WORDS,
        "B": 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"),
        "C": 100 * F.col("upper") > UPPER_PERCENT * F.col("points"),
        "D": F.col("marked"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    bits = [F.when(fails[f], F.lit(1 << i)).otherwise(0) for i, f in enumerate(FILTERS)]
    return joined.select("part", "doc_id", "row", sum(bits[1:], bits[0]).alias("failed"),
                         "words", "distinct", "points", "upper", "marked", "digest")


def _of(letters) -> int:
    return sum(1 << FILTERS.index(f) for f in letters)


def evaluated(cells: DataFrame) -> DataFrame:
    """All orders on counts ``part failed n good toxic`` (one row per part and set of filters)."""
    spark, size = cells.sparkSession, len(FILTERS)
    combos = [(1 << i, before) for i in range(size) for before in range(1 << size) if not before >> i & 1]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.lit(b).alias("before")) for f, b in combos])).alias("c")
    has = F.col("failed").bitwiseAND(F.col("c.f")) != 0
    met = F.col("failed").bitwiseAND(F.col("c.before")) != 0

    def count(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    steps = cells.select("*", pairs).groupBy("part", "c.f", "c.before").agg(
        count(~has & ~met).alias("kept"), count(has & ~met).alias("removed"),
        count(has & met).alias("redundant"), count(F.col("failed") == F.col("c.f")).alias("unique_fails"),
        count(has & ~met, "good").alias("good_lost"), count(has & ~met, "toxic").alias("toxic_lost"))
    # before a filter stand the same others in |before|! * (rest)! orders
    orders = F.element_at(F.array(*[
        F.lit(factorial(n) * factorial(size - 1 - n)) for n in range(size)]), F.bit_count("before") + 1)
    shapley = F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "f"))
    places = [("".join(p), i + 1, _of(p[i]), _of(p[:i])) for p in permutations(FILTERS) for i in range(size)]
    table_of = spark.createDataFrame(places, "filter_order string, step int, f int, before int")
    return (
        steps.withColumn("shapley", shapley)
        .join(F.broadcast(table_of), ["f", "before"])  # one row per order and step: 600
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                "toxic_lost", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text",
          doc_id: str = "doc_id") -> DataFrame:
    """Per part, order and step: what the filter keeps and removes, and what it would remove alone."""
    fails = failures(docs, F.coalesce(F.col(part).cast("string"), F.lit("")), text, doc_id)
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    cells = salted(fails, marks, ["doc_id"], F.col("row"), "left", broadcast=False).groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return evaluated(cells)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
first AS (SELECT body, min(doc_id) AS id FROM d GROUP BY body),
marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(d.words) < 50,
    100 * len(list_distinct(d.words)) < 65 * len(d.words),
    100 * length(regexp_replace(d.body, '[^A-Z]', '', 'g')) > 5 * length(d.body),
    regexp_matches(d.body, '[#$%&*|]'),
    coalesce(d.doc_id > f.id, false)] AS fails
  FROM d JOIN first f ON d.body = f.body LEFT JOIN marks m ON d.doc_id = m.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM f a, f b, f c, f e, f g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
steps AS (
  SELECT list_aggregate(list_transform(o, lambda x: 'ABCDE'[x]), 'string_agg', '') AS filter_order,
         s.i AS step, o[s.i] AS now, o[1:s.i - 1] AS before
  FROM orders, f s),
r AS (
  SELECT part, filter_order, step, now,
         n, good, toxic, fails[now] AS has,
         len(list_filter(before, lambda x: fails[x])) > 0 AS met,
         len(list_filter(fails, lambda x: x)) AS bad
  FROM cells, steps),
t AS (
  SELECT part, filter_order, step::INT AS step, now,
    coalesce(sum(n) FILTER (NOT has AND NOT met), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (has AND NOT met), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (has AND met), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (has AND bad = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (has AND NOT met), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (has AND NOT met), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, now)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, now)::BIGINT AS shapley
FROM t
"""
