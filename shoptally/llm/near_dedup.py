"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; a shingle weighs its count times an inverse
document frequency. Frequencies are counted over all rows into a table of ``1 << CELLS`` counters,
so the table every task needs has a fixed size. The idf is mild (1 to ``1 + IDF_SPAN``): with a full
logarithm, thousands of copies of one page would make each other's common shingles worthless and a
copy's few edits decisive, and true copies would fall below the threshold.

``BANDS * ROWS`` consistent weighted samples per text are banded: texts that agree in all samples of
a band share a bucket. Two texts with weighted Jaccard similarity s share one of the buckets with
probability ``1 - (1 - s**ROWS)**BANDS``: 0.998 at 0.8. In a bucket every text is compared with the
bucket's centre (the text that shares most buckets with most others); in further rounds, texts of a
bucket that are not connected yet are compared with its next centre. So pairs grow in proportion to
the rows, a bucket of thousands of copies costs one comparison per copy, and no group meets in one
task. What is still open after ``ROUNDS`` centres is mostly pages that are alike, but less than 0.8.
Those that hold too few shingles of others to have a partner are decided by that. The others get
``FINE_BANDS * FINE_ROWS`` further samples, and their finer buckets are compared with ever more
centres until every pair of a bucket is decided. Every link is verified by the weighted Jaccard
similarity of the whole texts' shingles, and classes are the connected components of the links.

A link is missed only if its texts share no bucket (0.4 % at exactly 0.8) and nothing else connects
them. Texts that are all between 0.7 and 0.8 alike and of which none links with another are the one
case where comparisons grow faster than rows: no sample tells 0.79 from 0.80.

Defined cases: texts with the same words in the same order are one text. A text of one to four words
is one shingle. NULL texts and texts without a word stand alone. Rows that repeat an id are rows of
their own. A class's id is the smallest ``doc_id`` in it (NULL only if all are). Extra columns are
ignored by ``classes`` and carried by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import (
    Vocabulary,
    byte_slices,
    columns_apart,
    filter_words,
    in_filter,
    narrow,
    salted,
    slices,
    table,
    tasks,
    without_tables,
    worker_table,
    written,
)

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 9, 3
#: centres per bucket before what is left is banded anew
ROUNDS = 3
#: what is open then is banded anew: pairs at 0.8 meet with 0.998, those at 0.7 with 0.79, at 0.6 with 0.29
FINE_BANDS, FINE_ROWS = 56, 10
CELLS = 20
IDF_SPAN = 0.1
#: comparisons with one centre in one task
_PART = 256
#: room for rounding in bounds that must not hold back a pair
_SLACK = 1 - 1e-6
#: the same for outlines: sums are too large by less than 1 / 128, and the union is at least half of both
_OUTLINE = 0.98
_SLICE = 1 << 21
_BLOCK = 4096
#: shingles sampled at a time
_WIDTH = 512
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_values(fresh: list[str]) -> list[np.ndarray]:
    """A hash per chunk of its letters and digits in lower case; 0 where it has none."""
    words = ["".join(filter(str.isalnum, c.lower())) for c in fresh]
    return [np.array([xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in words], np.uint64)]


def shingles(texts: list[str]) -> Iterator[np.ndarray]:
    """Per text the hashes of its shingles, in order, repeats included."""
    held = worker_table("words", "", lambda: Vocabulary(word_values))
    numbers, sizes = held.numbers(texts)
    values = held.values[0][numbers] if len(numbers) else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    rolled = None
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        words = values[end - size:end]
        words = words[words != 0]
        width = min(WORDS, len(words))
        if not width:
            yield words
            continue
        rolled = words[:len(words) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * _P + words[k:len(words) - width + 1 + k]
        yield mixed(rolled + np.uint64(width))


def sequence_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a text's shingles in order: equal for texts with the same words."""
    raw = found.tobytes()
    value = xxhash.xxh3_128_intdigest(raw)
    to_long = lambda x: x - (1 << 64) if x >> 63 else x
    return to_long(value >> 64), to_long(value & ((1 << 64) - 1))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of this task have a shingle in each cell, in blocks of cells."""
    counts = np.zeros(1 << CELLS, np.int64)
    rows = 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in byte_slices(texts, _SLICE):
            for found in shingles(texts[lo:hi]):
                rows += 1
                counts[np.unique(found >> np.uint64(64 - CELLS)).astype(np.int64)] += 1
    if rows:
        blocks = np.flatnonzero(counts.reshape(-1, _BLOCK).any(axis=1))
        for b in blocks.tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()),
                 pa.array([counts[b * _BLOCK:(b + 1) * _BLOCK].tobytes()], pa.binary())],
                names=["block", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([np.array([rows], np.int64).tobytes()], pa.binary())],
            names=["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition, one block being held per block number."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(raw.as_buffer(), np.int64)
            total[block] = total[block] + counts if block in total else counts.copy()
    for block, counts in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())],
            names=["block", "counts"])


def frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The idf of every cell, from all rows: a table of ``1 << CELLS`` numbers, whatever the input."""
    kind = "block int, counts binary"
    partial = columns_apart(docs, [text]).select(F.coalesce(text, F.lit("")).alias("body")).mapInArrow(_cells, kind)
    summed = partial.repartition(tasks(docs.sparkSession), "block").mapInArrow(_added, kind).toArrow()
    counts, rows = np.zeros(1 << CELLS), 1
    for block, raw in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True):
        if block < 0:
            rows = int(np.frombuffer(raw, np.int64)[0])
        else:
            counts[block * _BLOCK:(block + 1) * _BLOCK] = np.frombuffer(raw, np.int64)
    rarity = np.log(rows / np.clip(counts, 1, rows)) / np.log(max(rows, 2))
    return (1 + IDF_SPAN * rarity).astype(np.float32)


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights."""
    kinds, counts = np.unique(found, return_counts=True)
    return kinds, counts * idf[(kinds >> np.uint64(64 - CELLS)).astype(np.int64)]


class Sampler:
    """Improved consistent weighted sampling. The gamma and uniform variates a shingle needs per
    sample come from tables of quantiles, addressed by the shingle's hash under the sample's seed."""

    BITS = 16

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = 1 << self.BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def samples(self, kinds: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per sample a 64-bit value: equal for two texts with probability of their similarity."""
        logs = np.log(weights).astype(np.float32)
        count = len(self.seeds)
        lowest = np.full(count, np.inf, np.float32)
        chosen, step = np.zeros(count, np.int64), np.zeros(count, np.float32)
        every = np.arange(count)
        for begin in range(0, len(kinds), _WIDTH):  # all samples of a stretch of shingles at once
            h = self.seeds[:, None] * kinds[begin:begin + _WIDTH]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            parts = h.view(np.uint16).reshape(count, -1, 4)
            r, beta = self.r[parts[:, :, 0]], self.beta[parts[:, :, 1]]
            t = np.floor(logs[begin:begin + _WIDTH] / r + beta)
            log_a = self.log_c[parts[:, :, 3]] - r * (t - beta + 1)
            best = log_a.argmin(axis=1)
            value = log_a[every, best]
            better = value < lowest
            lowest = np.where(better, value, lowest)
            step = np.where(better, t[every, best], step)
            chosen = np.where(better, begin + best, chosen)
        return kinds[chosen] ^ mixed(step.astype(np.int64).astype(np.uint64))


_SAMPLERS: dict[tuple[int, int], Sampler] = {}


def sampler(samples: int = BANDS * ROWS, seed: int = 5) -> Sampler:
    if (samples, seed) not in _SAMPLERS:
        _SAMPLERS[samples, seed] = Sampler(samples, seed)
    return _SAMPLERS[samples, seed]


def band_keys(samples: np.ndarray, bands: int, rows: int) -> list[int]:
    """One key per band of ``rows`` samples."""
    taken = samples.reshape(bands, rows)
    mix = np.zeros(bands, np.uint64)
    for column in range(rows):
        mix = mixed(mix * _P + taken[:, column])
    return mix.view(np.int64).tolist()


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, draw = shared.value, sampler()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo, hi in byte_slices(texts, _SLICE):
                keys, bands = [], []
                for found in shingles(texts[lo:hi]):
                    if not len(found):
                        keys.append((None, None))
                        bands.append(None)
                        continue
                    keys.append(sequence_key(found))
                    bands.append(band_keys(draw.samples(*weighted(found, idf)), BANDS, ROWS))
                f1, f2 = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(lo, hi - lo) for i in range(3)],
                     pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "k1", "k2", "f1", "f2", "bands"])

    return run


def _vectors(shared, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, words = shared.value, wanted.value
        for batch in batches:
            rows = np.flatnonzero(in_filter(words, batch.column(0).to_numpy()))
            if not len(rows):
                continue
            batch = batch.take(pa.array(rows))
            texts = batch.column(2).to_pylist()
            for lo, hi in byte_slices(texts, _SLICE):
                both = [weighted(found, idf) for found in shingles(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array([k.tobytes() for k, _ in both], pa.binary()),
                     pa.array([w.astype(np.float32).tobytes() for _, w in both], pa.binary())],
                    names=["k1", "k2", "kinds", "weights"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted vectors."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum(dtype=np.float64)
    union = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common
    return float(common / union) if union else 0.0


def exact(kinds, weights) -> tuple[np.ndarray, np.ndarray]:
    """A vector from its two buffers."""
    return np.frombuffer(kinds, np.uint64), np.frombuffer(weights, np.float32)


def folded(kinds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector's outline in a third of its bytes: weights summed by 16 bits of the shingle and
    rounded up to the upper half of a float, by less than 1 / 128. The least of two sums is no less
    than the sum of the least, so two outlines share no less than their vectors."""
    cells, of = np.unique(mixed(kinds).astype(np.uint16), return_inverse=True)
    sums = np.bincount(of, weights, len(cells)).astype(np.float32)
    return cells, ((sums.view(np.uint32) + np.uint32(0xFFFF)) >> np.uint32(16)).astype(np.uint16)


def outline(cells, sums) -> tuple[np.ndarray, np.ndarray]:
    """An outline from its two buffers, as a vector."""
    high = np.frombuffer(sums, np.uint16).astype(np.uint32) << np.uint32(16)
    return np.frombuffer(cells, np.uint16), high.view(np.float32)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    without_tables()
    for batch in batches:
        both = [folded(*exact(k.as_buffer(), w.as_buffer())) for k, w in zip(
            batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([c.tobytes() for c, _ in both], pa.binary()),
             pa.array([s.tobytes() for _, s in both], pa.binary())], names=["node", "kinds", "weights"])


def _verify(threshold: float, read):
    """Rows sorted by (``a``, ``part``), the centre (``b`` NULL) before its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_tables()
        centre = None
        for batch in batches:
            near = []
            for i, b in enumerate(batch.column(2).to_pylist()):
                vector = read(batch.column(3)[i].as_buffer(), batch.column(4)[i].as_buffer())
                if b is None:
                    centre = vector[0].copy(), vector[1].copy()  # outlives its batch
                elif similarity(centre, vector) >= threshold:
                    near.append(i)
            found = batch.take(pa.array(near, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for all nodes of ``links`` (``a``,
    ``b``). Alternates two steps until nothing changes: every node hands its smallest neighbour to
    its larger neighbours, then to its smaller ones. Minima are aggregates and joins are salted, so
    a node with a third of all links is no single task's work."""
    now = written(narrow(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        "u <> v").distinct()), "links")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        # larger neighbours learn the smallest
        wide = salted(both.where("v > u"), least, ["u"], F.col("v")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        up = written(narrow(wide.union(
            least.where("m < u").select("u", F.col("m").alias("v"))).distinct()), "links")
        # smaller neighbours learn the smallest
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        close = salted(up, low, ["u"], F.col("v")).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(narrow(close.union(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()), "links")
        # done when every node has one link and no root is a node below another
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            now.select("v", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 OR up = 1 AND down = 1").limit(1).count():
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float, read=exact) -> DataFrame:
    """The pairs (``a`` centre, ``b``) whose vectors, or outlines, are similar. A centre's vector goes to
    one task per ``_PART`` pairs, once, and the vectors of its partners follow it one at a time."""
    many = pairs.groupBy("a").agg((1 + F.expr(f"count(*) div {_PART}")).alias("parts"))
    centres = vectors.join(many, vectors["node"] == many["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"), "kinds", "weights")
    placed = salted(pairs, many, ["a"], F.col("b")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    partners = placed.join(vectors, placed["b"] == vectors["node"]).select("a", "part", "b", "kinds", "weights")
    return centres.union(partners).repartition(tasks(pairs.sparkSession), "a", "part").sortWithinPartitions(
        "a", "part", F.col("b").asc_nulls_first()).mapInArrow(_verify(threshold, read), "a long, b long")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every text with the text's root."""
    without_tables()
    for batch in batches:
        kinds = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column(1)]
        sizes = [8 * len(k) for k in kinds]
        for lo, hi in slices(sizes, _SLICE):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy()[lo:hi], [len(k) for k in kinds[lo:hi]])),
                 pa.array(np.concatenate(kinds[lo:hi]))], names=["root", "shingle"])


def _finer(shared, threshold: float):
    """Per text that can have a partner: its weight, how much of it other roots share, finer bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_tables()
        words, draw = shared.value, sampler(FINE_BANDS * FINE_ROWS, 6)
        for batch in batches:
            rows, total, common, bands = [], [], [], []
            for i, (raw, heavy) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                kinds = np.frombuffer(raw.as_buffer(), np.uint64)
                weights = np.frombuffer(heavy.as_buffer(), np.float32)
                whole = weights.sum(dtype=np.float64)
                part = weights[in_filter(words, kinds.view(np.int64))].sum(dtype=np.float64)
                if part < threshold * _SLACK * whole:
                    continue
                rows.append(i)
                total.append(whole)
                common.append(part)
                bands.append(band_keys(draw.samples(kinds, weights), FINE_BANDS, FINE_ROWS))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(total, pa.float64()), pa.array(common, pa.float64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["node", "root", "total", "common", "bands"])

    return run


def finer(rest: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``node root total common bands`` of those texts of ``rest`` (``node``, ``root``) that can be
    similar to a text of another root. What two texts share lies in shingles that texts of two roots
    hold; a text with less than ``threshold`` of its weight in them has no partner. Those shingles
    are kept as a bit table of fixed size that may let texts through and holds none back."""
    spark = rest.sparkSession
    full = written(rest.join(vectors, "node").select("node", "root", "kinds", "weights").repartition(
        tasks(spark), "node"), "near-open")
    held = full.select("root", "kinds").mapInArrow(_posted, "root long, shingle long").groupBy("shingle").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    words = spark.sparkContext.broadcast(filter_words(held, "shingle"))  # of fixed size
    return written(full.repartition(tasks(spark), "node").mapInArrow(
        _finer(words, threshold), "node long, root long, total double, common double, bands array<long>"), "near-finer")


_PARTS = f"1 + n div {_PART}"


def repeated(centre: DataFrame) -> DataFrame:
    """Every centre once per ``_PART`` members of its bucket, whose size is ``n``."""
    return centre.withColumn("part", F.explode(F.expr(f"sequence(0L, {_PARTS} - 1)"))).drop("n")


def met_centres(met: DataFrame, centre: DataFrame) -> DataFrame:
    """Members of buckets with the centres of their bucket. Both sides know the bucket's size, so only
    a bucket that is too large for one task is dealt out and repeats its centres."""
    left = met.withColumn("part", F.expr(f"pmod(xxhash64(node), {_PARTS})"))
    return left.join(repeated(centre), ["band", "value", "part"]).drop("part")


def finer_links(rest: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Verified links (``a``, ``b``) between texts of ``rest`` (``node``, ``root``) with different
    roots that share a finer bucket. Every round compares the members of each open bucket with more
    centres than before, and what is linked then counts as one; a bucket of few members is compared
    whole. Ends when no bucket is open, so no pair of a bucket is left undecided."""
    open_texts = finer(rest, vectors, threshold)
    outlines = written(vectors.join(open_texts.select("node"), "node", "left_semi").select(
        "node", "kinds", "weights").mapInArrow(_outlines, "node long, kinds binary, weights binary"), "near-outlines")
    active = open_texts.select("node", "root", "total", "common", F.posexplode("bands").alias("band", "value"))
    found, known, centres = None, None, 1
    while True:
        open_buckets = active.groupBy("band", "value").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(
            "band", "value", "n")
        met = written(narrow(salted(active, open_buckets, ["band", "value"], F.col("node")).withColumn(
            "central", F.expr(f"n <= {2 * centres} OR pmod(xxhash64(node, band, {centres}), n) < {centres}"))), "near-met")
        if not met.limit(1).count():
            return found if found is not None else rest.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
        centre = met.where("central").select(
            "band", "value", "n", F.col("node").alias("a"), F.col("root").alias("a_root"),
            F.col("total").alias("a_total"), F.col("common").alias("a_common"))
        # at least the threshold of both texts' weights must lie in what either can share
        fits = F.lit(1 + threshold) * F.least("common", "a_common") >= F.lit(threshold * _SLACK) * (
            F.col("total") + F.col("a_total"))
        pairs = met_centres(met, centre).where(
            fits & F.expr("root <> a_root AND (NOT central OR a < node)")).select(
            "a", F.col("node").alias("b"), "a_root", F.col("root").alias("b_root"),
            F.least("a", "node").alias("lo"), F.greatest("a", "node").alias("hi")).dropDuplicates(["lo", "hi"])
        pairs = written(narrow(pairs if known is None else pairs.join(known, ["lo", "hi"], "left_anti")), "near-pairs")
        known = pairs.select("lo", "hi") if known is None else known.union(pairs.select("lo", "hi"))
        # most pairs here are no links, and their outlines tell
        likely = written(narrow(verified(pairs.select("a", "b"), outlines, threshold * _OUTLINE, outline)), "near-likely")
        fresh = written(narrow(verified(likely, vectors, threshold)), "near-links")
        found = fresh if found is None else found.union(fresh)
        active = met.where("NOT central").drop("n", "central")
        if fresh.limit(1).count():
            joined = components(pairs.join(fresh, ["a", "b"]).select(
                F.col("a_root").alias("a"), F.col("b_root").alias("b")))
            active = salted(active, joined.select(F.col("node").alias("root"), F.col("root").alias("now")), ["root"],
                            F.col("node"), "left").withColumn("root", F.coalesce("now", "root")).drop("now")
        centres *= 8


def signatures(docs: DataFrame, idf, text: str, doc_id: str) -> DataFrame:
    rows = columns_apart(docs, [doc_id, text]).select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        "doc_id", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(1), "body").alias("k2"), "body")
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign(idf), f"doc_id {kind}, k1 long, k2 long, f1 long, f2 long, bands array<long>")
    return written(signed.withColumn("node", F.monotonically_increasing_id()), "near-signatures")


def links(docs: DataFrame, signed: DataFrame, idf, text: str, threshold: float = THRESHOLD,
          rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Nodes standing for different texts, and verified links between them."""
    spark = docs.sparkSession
    texts = written(narrow(signed.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("node").alias("node"))), "near-texts")
    banded = signed.join(texts.select("node"), "node", "left_semi").select(
        "node", "k1", "k2", F.posexplode("bands").alias("band", "value"))
    banded = written(narrow(banded), "near-bands")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = written(narrow(salted(banded, sizes, ["band", "value"], F.col("node"))), "near-buckets")
    central = members.groupBy("node").agg(F.sum("n").alias("met"), F.first("k1").alias("k1"),
                                          F.first("k2").alias("k2"))
    central = written(narrow(central), "near-central")
    body = columns_apart(docs, [text]).select(F.coalesce(F.col(text), F.lit("")).alias("body")).select(
        F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(1), "body").alias("k2"), "body")
    wanted = spark.sparkContext.broadcast(filter_words(central, "k1"))  # of fixed size
    found = body.mapInArrow(_vectors(idf, wanted), "k1 long, k2 long, kinds binary, weights binary")
    # different nodes may have one text only if the words differ, so (k1, k2) names one node
    vectors = written(found.join(central.select("node", "k1", "k2"), ["k1", "k2"]).select(
        "node", "kinds", "weights").dropDuplicates(["node"]), "near-vectors")
    active = written(narrow(members.select("band", "value", "node").join(central.select("node", "met"), "node")),
                     "near-active").withColumn("root", F.col("node"))
    found = known = None
    for _ in range(rounds):
        centre = active.groupBy("band", "value").agg(
            F.max(F.struct("met", (-F.col("node")).alias("minus"), "root")).alias("top")).select(
            "band", "value", (-F.col("top.minus")).alias("a"), F.col("top.root").alias("a_root"))
        met = written(narrow(salted(active, centre, ["band", "value"], F.col("node"))), "near-met")
        pairs = met.where("root <> a_root").select("a", F.col("node").alias("b")).distinct()
        pairs = written(narrow(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")), "near-pairs")
        fresh = written(narrow(verified(pairs, vectors, threshold)), "near-links")
        found = fresh if found is None else found.union(fresh)
        known = pairs if known is None else known.union(pairs)
        roots = written(narrow(components(found)), "near-roots")
        active = met.where("node <> a").select("band", "value", "node", "met").join(
            roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_buckets = active.groupBy("band", "value").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "value")
        active = written(narrow(salted(active, open_buckets, ["band", "value"], F.col("node"))), "near-active")
        if not active.limit(1).count():
            return texts, found
    rest = written(narrow(active.select("node", "root").distinct()), "near-rest")
    return texts, found.union(finer_links(rest, vectors, threshold))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``node doc_id class_id class_size text_node root`` and the row's text keys ``k1 k2``.
    ``root`` names the class; two classes may have one ``class_id``, as ids may repeat."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(frequencies(docs, text))  # of fixed size
    signed = signatures(docs, idf, text, doc_id)
    texts, found = links(docs, signed, idf, text, threshold)
    roots = components(found).withColumnRenamed("node", "text_node")
    named = salted(signed.select("node", "doc_id", "k1", "k2", "f1", "f2"),
                   texts.withColumnRenamed("node", "text_node"), ["f1", "f2"], F.col("node"), "left")
    # a row without words stands for itself
    named = named.withColumn("text_node", F.coalesce("text_node", "node"))
    rooted = written(salted(named, roots, ["text_node"], F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "text_node")), "near-rooted")
    sizes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return salted(rooted, sizes, ["root"], F.col("node")).select(
        "node", "doc_id", "class_id", "class_size", "text_node", "root", "k1", "k2", F.isnull("f1").alias("alone"))


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One whole row of ``docs`` per class: the one with the smallest ``doc_id``."""
    # of rows that repeat the id, and of NULL ids, one per class stays
    kept = classes(docs, text, doc_id).where(F.expr("doc_id <=> class_id")).groupBy("root").agg(
        F.min(F.struct("node", "k1", "k2", "doc_id", "alone")).alias("_first")).select(
        F.col("_first.doc_id").alias("_id"), F.col("_first.k1").alias("_k1"),
        F.col("_first.k2").alias("_k2"), F.col("_first.alone").alias("_alone")).distinct()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the row goes along as one column, so none of its names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("a"),
                       F.xxhash64(F.lit(1), body).alias("b"), F.col(f"`{doc_id}`").alias("id"))
    own = (F.col("a") == F.col("_k1")) & (F.col("b") == F.col("_k2")) & F.col("id").eqNullSafe(F.col("_id"))
    # rows without words are classes of their own and all stay
    joined = rows.join(kept, own).withColumn("alone", F.when(F.col("_alone"), F.monotonically_increasing_id()))
    return joined.dropDuplicates(["a", "b", "id", "alone"]).select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", F.expr("doc_id <=> class_id").alias("kept"))
