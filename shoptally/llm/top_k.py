"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments; each segment is described by its mean and its deviation. For two
vectors the squared distance is at least the sum over segments of
``length * ((mean - mean')**2 + (deviation - deviation')**2)``, and with the two squared norms this
bounds their inner product from above. Going from few long segments to many short ones, candidates
whose bound stays below the k-th score found so far drop out; the survivors are scored exactly. No
result is lost: a candidate drops out only if k others certainly score higher.

Queries and candidates are packed into blocks of bounded size; every pair of blocks is one row of
work, so tasks share the work evenly and hold two blocks at a time. Each pair leaves its k best per
query, and the best of those are ranked per query.

Defined cases: vectors that are NULL, or hold a NULL, NaN or infinite component, take no part; an
empty vector takes part with all scores 0. Vectors of different lengths have no score. Ties go to
the smaller ``vec_id``; a NULL id takes no part. Rows that repeat an id are candidates each, but not
for a query of the same id. Scores beyond 64 bits are clipped to the 64-bit range. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shoptally.llm.common import SALTS, salted, table, tasks, written

#: vectors per block; a block of 64 components is 1 MB
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 2048
#: pairs scored at a time
_PAIRS = 1 << 15
#: segments per resolution, coarse to fine
LEVELS = (4, 16)
#: sums below this are exact in doubles
_EXACT = float(1 << 52)


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` per component as whole doubles; NULL if a component is not finite."""
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), doubles)


def statistics(block: np.ndarray, parts: int) -> np.ndarray:
    """Per vector: means and deviations of ``parts`` segments, times the root of the length. The
    inner product of two such rows bounds the inner product of the vectors from above."""
    edges = np.linspace(0, block.shape[1], parts + 1).astype(int)
    columns = []
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        if begin < end:
            part = block[:, begin:end]
            root = np.sqrt(end - begin)
            columns += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(columns, axis=1) if columns else np.zeros((len(block), 1))


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of rows pairwise, as 64-bit integers."""
    if not queries.size:
        return np.zeros(len(queries), np.int64)
    bound = np.abs(queries).max() * np.abs(candidates).max() * queries.shape[1]
    if bound < _EXACT:
        return np.einsum("ij,ij->i", queries, candidates).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q, c, strict=True)), low), high)
                     for q, c in zip(queries, candidates, strict=True)], np.int64)


def _best(q_ids, q, c_ids, c, k: int) -> pd.DataFrame:
    """The k best candidates of one block for every query of another."""
    same = q_ids[:, None] == c_ids[None, :]
    alive = ~same
    floor = np.full(len(q), -np.inf)
    # a first bar: exact scores of the k candidates with the highest coarse bounds
    bounds = [statistics(q, LEVELS[0]) @ statistics(c, LEVELS[0]).T]
    first = np.where(alive, bounds[0], -np.inf)
    width = min(2 * k, len(c))
    trial = np.argpartition(-first, width - 1, axis=1)[:, :width]
    at = np.repeat(np.arange(len(q)), width)
    tried = scores(q[at], c[trial.ravel()]).reshape(len(q), width).astype(float)
    tried[np.take_along_axis(same, trial, axis=1)] = -np.inf
    if width >= k:
        floor = np.partition(tried, width - k, axis=1)[:, width - k]
    for level, parts in enumerate(LEVELS):
        bound = bounds[0] if level == 0 else statistics(q, parts) @ statistics(c, parts).T
        slack = 1e-9 * np.abs(bound) + 1e-6  # rounding of the bound itself
        # scores of 2**52 and more lose digits as doubles: the bar is lowered by as much
        alive &= bound + slack >= (floor - 1e-9 * np.abs(np.nan_to_num(floor, neginf=0)))[:, None]
    rows, cols = np.nonzero(alive)
    exact = np.concatenate([np.zeros(0, np.int64), *[
        scores(q[rows[i:i + _PAIRS]], c[cols[i:i + _PAIRS]]) for i in range(0, len(rows), _PAIRS)]])
    order = np.lexsort((c_ids[cols], ~exact, rows))  # ~x falls as x rises, and never overflows
    rows, cols, exact = rows[order], cols[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    top = rank < k
    return pd.DataFrame({"query_id": q_ids[rows[top]], "vec_id": c_ids[cols[top]],
                         "score": exact[top]})


def _packed(size: int):
    """Blocks of up to ``size`` vectors of one length, as raw doubles."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, vectors = zip(*held.pop(dim), strict=True)
            matrix = np.array(vectors, np.float64).reshape(len(ids), dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()],
                                 "matrix": [matrix.tobytes()]})

        for frame in frames:
            for vec_id, vector in zip(frame["vec_id"], frame["v"], strict=True):
                held.setdefault(len(vector), []).append((vec_id, vector))
                if len(held[len(vector)]) == size:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return pack


def _search(k: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids = np.frombuffer(row.q_ids, np.int64)
                c_ids = np.frombuffer(row.c_ids, np.int64)
                q = np.frombuffer(row.q_matrix, np.float64).reshape(len(q_ids), row.dim)
                c = np.frombuffer(row.c_matrix, np.float64).reshape(len(c_ids), row.dim)
                yield _best(q_ids, q, c_ids, c, k)

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024,
            vec_id: str = "vec_id", embedding: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Per query its ``k`` candidates of highest score: ``query_id rank vec_id score``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("asks"),
        quantised(F.col(embedding), scale).alias("v")).where("v IS NOT NULL")

    def blocks(part: DataFrame, size: int, name: str) -> DataFrame:
        packed = part.select("vec_id", "v").mapInPandas(
            _packed(size), "dim int, ids binary, matrix binary")
        return written(packed.select(F.monotonically_increasing_id().alias("block"), "*"), name)

    few = max(1, tasks(spark) // 8)  # the queries are few: full blocks rather than many
    asked = blocks(rows.where("asks").repartition(few, "vec_id"), query_block, "topk-queries")
    given = blocks(rows, candidate_block, "topk-candidates")
    # only the numbers of the blocks are paired; the blocks then join these by number
    q = asked.select(F.col("block").alias("q_block"), "dim")
    c = given.select(F.col("block").alias("c_block"), "dim")
    pairs = salted(c, q, ["dim"], F.col("c_block"), salts=max(SALTS, tasks(spark)))
    pairs = pairs.repartition(tasks(spark), F.xxhash64("q_block", "c_block")).drop("dim")
    work = (
        pairs.join(asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                                F.col("matrix").alias("q_matrix")), "q_block")
        .join(given.select(F.col("block").alias("c_block"), "dim", F.col("ids").alias("c_ids"),
                           F.col("matrix").alias("c_matrix")), "c_block")
    )
    found = work.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
