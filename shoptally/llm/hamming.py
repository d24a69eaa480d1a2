"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes.

A code is the signs of a vector's principal components after a rotation learned to lose least by
taking signs. It is split into substrings, and every substring indexes all codes. If two codes differ
in at most ``radius`` bits, then by the pigeonhole principle some substring differs in at most its
share of them, so probing each index within its share retrieves every code within the radius. The
codes found are compared in full, and those within the radius are reranked by the vectors themselves.

Model and radius come from a bounded sample (``FIT_ROWS`` rows, those with the smallest hashes of
their ids): the radius holds ``COVERED`` of the true neighbours within the sample, which lie further
off than those among all rows. All rows are indexed. A query that finds fewer than ``k`` rows is asked
again with a wider radius, at last with one that holds every code, so no query goes short.

The index is dealt out by substring, leading bits of its value, and a share of the rows (a common
vector is spread over ``SHARES``), and packed into small blocks sorted by substring. A query goes only
to the prefixes within its share of the radius. Of the indexes that retrieve one pair only the first
reranks it. A block leaves the best ``k`` of each query, which are merged per query.

Defined cases: vectors that are NULL, empty, all zero, or hold a NULL, NaN or infinite component take
no part, nor does a NULL id. Vectors of different lengths have no distance; each length has its own
model, and a length that the sample holds too rarely one of random directions, searched in full. Ties
go to the smaller ``vec_id``. Rows that repeat an id are candidates each, but not for a query of the
same id; such queries share one list. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptally.llm.common import bits_for, table, tasks, written

BITS = 64
#: substrings of a code, each with an index of its own
SUBSTRINGS = 4
#: rows the model and the radius are fitted on
FIT_ROWS = 4096
#: of these, so many ask for their neighbours to find the radius
FIT_QUERIES = 512
COVERED = 0.97
#: fewer rows of one length in the sample than this: no model
FIT_LEAST = 256
#: parts of one prefix, so that a vector that many rows share is spread
SHARES = 8
#: vectors per block of the index and of the queries
INDEX_BLOCK = 1024
QUERY_BLOCK = 128
_PAIRS = 1 << 15
#: neighbours a task keeps while it searches
_HELD = 1 << 18
_FOUND = ("query_id", "vec_id", "score")
_SUB = BITS // SUBSTRINGS
_MASK = (1 << _SUB) - 1


def rotation(rows: np.ndarray, bits: int, seed: int, rounds: int = 40) -> np.ndarray:
    """Directions (a column per bit) whose signs are the code: principal components, turned so that
    they come close to the corners of a cube. More bits than components: several turns."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(rows.T @ rows)
    axes = axes[:, ::-1]
    out = []
    while bits:
        some = axes[:, :bits]
        z = rows @ some
        turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(z.T @ np.where(z @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        out.append(some @ turn)
        bits -= some.shape[1]
    return np.concatenate(out, axis=1)


def codes(rows: np.ndarray, centre: np.ndarray, directions: np.ndarray) -> np.ndarray:
    bits = (rows - centre) @ directions >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fitted(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Centre, directions and radius from the vectors of a sample."""
    centre = sample.mean(axis=0)
    directions = rotation(sample - centre, BITS, seed=sample.shape[1])
    code = codes(sample, centre, directions)
    squares = (sample**2).sum(axis=1)
    apart = []
    for i in range(min(FIT_QUERIES, len(sample))):
        far = squares - 2 * sample @ sample[i]
        far[i] = np.inf
        best = np.argpartition(far, k)[:k]
        apart.append(np.bitwise_count(code[best] ^ code[i]))
    return centre, directions, int(np.quantile(np.concatenate(apart), COVERED, method="higher"))


def untrained(length: int) -> tuple[np.ndarray, np.ndarray, int]:
    rng = np.random.default_rng(length)
    return np.zeros(length), rng.normal(size=(length, BITS)), BITS


class Model:
    """A model per length of vector."""

    def __init__(self, known: dict[int, tuple[np.ndarray, np.ndarray, int]]):
        self.known = known

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        return self.known.get(length) or untrained(length)

    def radius(self, length: int, wider: int) -> int:
        """The radius of a round: as fitted, half way to all bits, all bits."""
        fit = self.of(length)[2]
        return (fit, (fit + BITS) // 2, BITS)[wider]


def shares(radius: int) -> list[int]:
    """Bits by which each substring may differ: one code within ``radius`` differs in no more than
    its share in some substring. The shares add up to ``radius`` - SUBSTRINGS + 1; -1 asks nothing."""
    whole, rest = divmod(radius, SUBSTRINGS)
    return [whole if i <= rest else whole - 1 for i in range(SUBSTRINGS)]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id v``: vectors as doubles, only those that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), "asks",
    ).where(F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False)))


def trained(rows: DataFrame, k: int) -> Model:
    """Models from at most FIT_ROWS rows."""
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), F.xxhash64("v").alias("g"))
    by_length: dict[int, list] = {}
    for row in sample.orderBy("h", "g").limit(FIT_ROWS).select("v").collect():
        by_length.setdefault(len(row["v"]), []).append(row["v"])
    return Model({n: fitted(np.array(some), k) for n, some in by_length.items()
                  if len(some) >= max(FIT_LEAST, k + 1)})


def _encoded(model: Model):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["v"].str.len()
            for length, some in frame.groupby(lengths):
                rows = np.stack(some["v"].to_numpy()).astype(np.float64)
                centre, directions, _ = model.of(int(length))
                yield pd.DataFrame({
                    "vec_id": some["vec_id"], "asks": some["asks"], "length": np.int32(length),
                    "code": codes(rows, centre, directions).view(np.int64), "v": [r.tobytes() for r in rows]})

    return encode


def encoded(rows: DataFrame, model: Model) -> DataFrame:
    """``vec_id asks length code v``: 64-bit codes and vectors as raw doubles."""
    return rows.select("vec_id", "asks", "v").mapInPandas(
        _encoded(model), "vec_id bigint, asks boolean, length int, code bigint, v binary")


def _packed(keys: list[str], limit: int):
    """Rows come sorted by ``keys``; those of one key in blocks of at most ``limit`` rows."""
    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        return pd.DataFrame({**{k: rows[k].iloc[:1] for k in keys}, "ids": [rows["vec_id"].to_numpy().tobytes()],
                             "codes": [rows["code"].to_numpy().tobytes()], "vectors": [b"".join(rows["v"])]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, size = [], None, 0
        for frame in frames:
            for at, rows in frame.groupby(keys, sort=False):
                if held and (at != key or size >= limit):
                    yield block(held)
                    held, size = [], 0
                key = at
                while len(rows):
                    held.append(rows[:limit - size])
                    size += len(held[-1])
                    rows = rows[len(held[-1]):]
                    if size == limit:
                        yield block(held)
                        held, size = [], 0
        if held:
            yield block(held)

    return pack


_BLOCK = "ids binary, codes binary, vectors binary"
_KEYS = ["length", "sub", "prefix"]


def index(rows: DataFrame, prefix_bits: int) -> DataFrame:
    """One row per block: ``length sub prefix share`` and its vectors in the order of the substring."""
    spark = rows.sparkSession
    subs = F.explode(F.array(*[
        F.struct(F.lit(j).alias("sub"), F.shiftrightunsigned("code", _SUB * j).bitwiseAND(F.lit(_MASK)).alias("value"))
        for j in range(SUBSTRINGS)])).alias("s")
    dealt = rows.select("vec_id", "length", "code", "v", subs,
                        F.pmod(F.xxhash64("vec_id", "v"), F.lit(SHARES)).cast("int").alias("share"))
    dealt = dealt.select(
        "vec_id", "length", "code", "v", "s.sub", F.shiftright("s.value", _SUB - prefix_bits).cast("int").alias("prefix"),
        "share", "s.value")
    keys = [*_KEYS, "share"]
    sorted_rows = dealt.repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "value")
    return sorted_rows.select(*keys, "vec_id", "code", "v").mapInPandas(
        _packed(keys, INDEX_BLOCK), f"length int, sub int, prefix int, share int, {_BLOCK}")


def _probes(model: Model, wider: int, prefix_bits: int):
    """Queries with every prefix that may hold codes within their share of the radius."""
    prefixes = np.arange(1 << prefix_bits, dtype=np.uint64)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, some in frame.groupby("length"):
                code = some["code"].to_numpy().view(np.uint64)
                for j, share in enumerate(shares(model.radius(int(length), wider))):
                    value = (code >> np.uint64(_SUB * j)) & np.uint64(_MASK)
                    head = value >> np.uint64(_SUB - prefix_bits)
                    q, p = np.nonzero(np.bitwise_count(head[:, None] ^ prefixes[None, :]).astype(int) <= share)
                    if len(q):
                        yield pd.DataFrame({
                            "length": np.int32(length), "sub": np.int32(j), "prefix": p.astype(np.int32),
                            "vec_id": some["vec_id"].to_numpy()[q], "code": some["code"].to_numpy()[q],
                            "v": some["v"].to_numpy()[q]})

    return probe


def _distances(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[
        np.sqrt(((q[rows[i:i + _PAIRS]] - c[cols[i:i + _PAIRS]])**2).sum(axis=1))
        for i in range(0, len(rows), _PAIRS)]])


def within(q_codes: np.ndarray, c_codes: np.ndarray, sub: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within ``radius`` that this index retrieves first. ``c_codes`` are in the
    order of their substring, so its buckets are probed, not its rows."""
    limits = shares(radius)
    part = [(q_codes >> np.uint64(_SUB * j)) & np.uint64(_MASK) for j in range(sub + 1)]
    mine = (c_codes >> np.uint64(_SUB * sub)) & np.uint64(_MASK)
    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    sizes = np.diff(np.r_[starts, len(mine)])
    q, bucket = np.nonzero(np.bitwise_count(part[sub][:, None] ^ mine[starts][None, :]).astype(int) <= limits[sub])
    count = sizes[bucket]
    rows = np.repeat(q, count)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[bucket], count)
    near = np.bitwise_count(q_codes[rows] ^ c_codes[cols]) <= radius
    for j in range(sub):
        other = (c_codes[cols] >> np.uint64(_SUB * j)) & np.uint64(_MASK)
        near &= np.bitwise_count(part[j][rows] ^ other).astype(int) > limits[j]
    return rows[near], cols[near]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[top], vec[top], score[top]


def _searched(model: Model, wider: int, k: int):
    """Pairs of blocks to the best ``k`` per query; a task merges what it finds, ``_HELD`` rows at most."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return _best(*[np.concatenate(c) for c in zip(*held, strict=True)], k)

        for frame in frames:
            for r in frame.itertuples():
                q_ids, c_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                rows, cols = within(np.frombuffer(r.q_codes, np.uint64), np.frombuffer(r.codes, np.uint64), r.sub,
                                    model.radius(r.length, wider))
                other = q_ids[rows] != c_ids[cols]
                rows, cols = rows[other], cols[other]
                score = _distances(np.frombuffer(r.q_vectors, np.float64).reshape(len(q_ids), -1),
                                   np.frombuffer(r.vectors, np.float64).reshape(len(c_ids), -1), rows, cols)
                held.append(_best(q_ids[rows], c_ids[cols], score, k))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _HELD // 2:  # many queries: they go on as they are
                        yield pd.DataFrame(dict(zip(_FOUND, held[0], strict=True)))
                        held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(_FOUND, merged(), strict=True)))

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """Per query the ``k`` nearest rows found: ``query_id rank vec_id score``."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(vec_id), F.col(embedding), is_query.alias("asks"))
    usable_rows = usable(plain, vec_id, embedding)
    model = trained(usable_rows, k)
    rows = written(encoded(usable_rows, model), "hamming-codes")
    total = rows.count()
    prefix_bits = min(_SUB, bits_for(total / (SHARES * INDEX_BLOCK)))
    blocks = written(index(rows, prefix_bits), "hamming-index")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def found(asked: DataFrame, wider: int) -> DataFrame:
        probes = asked.select("vec_id", "length", "code", "v").mapInPandas(
            _probes(model, wider, prefix_bits), "length int, sub int, prefix int, vec_id bigint, code bigint, v binary")
        dealt = probes.repartition(tasks(spark), *_KEYS).sortWithinPartitions(*_KEYS)
        queries = dealt.mapInPandas(_packed(_KEYS, QUERY_BLOCK), f"length int, sub int, prefix int, {_BLOCK}")
        queries = queries.select(
            *_KEYS, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.col("ids").alias("q_ids"),
            F.col("codes").alias("q_codes"), F.col("vectors").alias("q_vectors"))
        keys = [*_KEYS, "share"]
        work = blocks.repartition(tasks(spark), *keys).join(queries.repartition(tasks(spark), *keys), keys)
        pairs = work.mapInPandas(_searched(model, wider, k), "query_id bigint, vec_id bigint, score double")
        ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), f"hamming-found-{wider}")

    queries = rows.where("asks")
    parts = []
    for wider in range(3):
        part = found(queries, wider)
        full = part.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        rest = queries.join(full, "vec_id", "left_anti")
        if wider == 2 or rest.isEmpty():
            parts.append(part)
            break
        parts.append(part.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi"))
        queries = written(rest, "hamming-rest")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
