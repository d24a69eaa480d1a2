"""Helpers the operators share: tables, written intermediates, salted joins, word splitting."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoptally.session import shared_folder

#: one third of all rows may carry one key: copies of the unique side of a salted join
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder: lineage ends here and nothing is computed
    twice. The files outlive a lost executor; Spark's context removes nothing, the cluster's
    clean-up of its checkpoint folder does."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame) -> DataFrame:
    """``df``, whose rows are a few ids, in no more partitions than keep all cores busy, so that small
    tables are not written as hundreds of files. Partitions are read one after the other, none is
    moved, and a task holds no more than one of them."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, tasks(spark) // 8))


def salted(many: DataFrame, one: DataFrame, keys: list[str], spread: Column,
           how: str = "inner", salts: int = SALTS, broadcast: bool = True) -> DataFrame:
    """Equi join of ``many`` with ``one`` (one row per key), a hot key being spread over ``salts``
    tasks. ``spread`` is any value that differs between the rows of ``many``. Without ``broadcast``
    the copies of ``one`` never pass the driver (``apart``)."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right if broadcast else apart(right), [*keys, "_salt"], how).drop("_salt")


def apart(side: DataFrame) -> DataFrame:
    """``side`` of a join that grows with the table: sorted and merged, never broadcast. Spark goes by
    the size of files and shuffled blocks, in which ids take a byte or less, and copies that a salt
    makes are not counted; in the driver's memory they take a hundred times as much."""
    return side.hint("merge")


#: bits of a filter of keys; 8 MB
FILTER_BITS = 26


def filter_words(keys: DataFrame, key: str) -> np.ndarray:
    """Words of a bit table in which the place of every 64-bit ``key`` of ``keys`` is set. Its size
    is fixed: with very many keys it lets more rows through than needed, and never holds one back."""
    place = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("word"),
                        F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & ((1 << FILTER_BITS) - 1)
    return ((words[place >> 6] >> (place & 63)) & 1).astype(bool)


def may_hold(shared, key: Column) -> Column:
    """Whether ``key`` may be among the keys of a broadcast filter."""
    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, keys.to_numpy()))

    return test(key)


def columns_apart(df: DataFrame, names: list[str]) -> DataFrame:
    """Only ``names`` of ``df``: whatever else a table carries cannot clash with working columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def with_fields(rows: DataFrame, more: str) -> StructType:
    """The fields of ``rows`` but its last, the text, and ``more``."""
    return StructType([*rows.schema.fields[:-1], *StructType.fromDDL(more).fields])


def fold(cast_of: Column, modulus: int) -> Column:
    """The fold a contract names: crc32 of an id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(cast_of.cast("string")), F.lit(modulus)).cast("int")


def bits_for(parts: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, parts))))


_BREAKS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def chunks(text: str) -> list[str]:
    """``text`` cut at white space as Unicode defines it (the information separators are not)."""
    if _BREAKS.search(text):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``sizes`` that sum up to about ``limit`` each; a larger one stands alone."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def byte_slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters each; a longer text stands alone."""
    return slices([len(t) for t in texts], limit)


class Vocabulary(dict):
    """Numbers the chunks of text a Python worker meets, and keeps what was computed for each.

    ``compute`` gets the new chunks of a batch and returns one array per kind of value, one row per
    chunk. Beyond ``limit`` chunks the table starts anew, so its memory is bounded.
    """

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.fresh: list[str] = []
        self.values: list[np.ndarray] = []
        self.used = 0

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.fresh.append(chunk)
        return number

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks of ``texts`` in a row, and how many each text has."""
        if len(self) > self.limit:
            self.clear()
            self.values, self.used = [], 0
        parts = [chunks(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        found = np.fromiter(
            map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self.fresh:
            self.grow([np.asarray(v) for v in self.compute(self.fresh)], len(self.fresh))
            self.fresh = []
        return found, sizes

    def grow(self, more: list[np.ndarray], count: int) -> None:
        if not self.values:
            self.values = [np.zeros((1024, *m.shape[1:]), m.dtype) for m in more]
        while self.used + count > len(self.values[0]):
            self.values = [np.concatenate([v, np.zeros_like(v)]) for v in self.values]
        for value, new in zip(self.values, more, strict=True):
            value[self.used:self.used + count] = new
        self.used += count


def summed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``rows`` (float64), empty stretches being 0."""
    total = np.concatenate([np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


_TABLES: dict[str, tuple] = {}


def worker_table(kind: str, token: str, make):
    """The table of a Python worker for one ``kind`` of work and one model (``token``). A worker
    serves stage after stage, so the table of another kind or an earlier model is let go."""
    if kind not in _TABLES or _TABLES[kind][0] != token:
        _TABLES.clear()
        _TABLES[kind] = (token, make())
    return _TABLES[kind][1]


def without_tables() -> None:
    """For tasks that need none: the table that an earlier stage left in this worker is let go."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()


_LETTER = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_symbols(chunk_list: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as a row of symbols, words apart by single zeros, and the chunk of each symbol. A symbol
    is the lower-case letter's code point, those beyond ``3 / 4`` of the range folded into the rest."""
    points = np.frombuffer("\n".join([c.lower() for c in chunk_list]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.append(points, np.uint32(10))
    of = np.cumsum(points == 10) - (points == 10)
    plain = 3 << (bits - 2)
    wide = plain + ((points * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits + 2))
    symbols = np.where(letters()[points], np.where(points < plain, points, wide), 0).astype(np.int64)
    before = np.concatenate([[0], symbols[:-1]])
    kept = (symbols != 0) | (before != 0)
    return symbols[kept], of[kept]
