"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each letter of a word, and its end, from up to four characters
before it. The counts come from all training rows: tasks count the five-character stretches of whole
texts, Spark sums them, and lower orders follow from the stretches themselves (Kneser-Ney counts of
different histories). Every language and every stretch is kept. Models of all languages share one
sorted table per order, a row per stretch and language with its discounted share. The language is
that of the lowest cross entropy per character. A text is rejected when even this is higher than
training texts of that language ever are, with an allowance for short texts; the limits come from all
training texts, whole.

Bounds: the model grows with the corpus, so it passes neither the driver nor a broadcast. Tasks write
it as sorted files of about ``FILE_ROWS`` rows into the shared folder; those who score map the files
they need into memory, which the system may drop again. What a worker computes at a time shrinks with
the number of languages. The driver holds the languages and the names of the files.

Defined cases: a NULL text or one without a letter is ``und`` with score 0, and rejected. Rows that
repeat an id are rows of their own. Ties go to the language first in the alphabet. Rows with a NULL
language are not learned from. Extra columns are ignored. Without training rows every text is
``und``, and only texts without a letter are rejected.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import (
    Vocabulary,
    byte_slices,
    chunks,
    columns_apart,
    fold,
    letter_symbols,
    slices,
    summed,
    table,
    with_fields,
    worker_table,
    written,
)
from shoptally.session import shared_folder

ORDER = 5
BITS = 12
#: rows of the model in one file, about
FILE_ROWS = 1 << 20
_SLICE = 1 << 21
#: values computed at a time, of all languages together
_VALUES = 1 << 24


def grams(chunk_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of all words of all chunks as packed keys, the predicted character lowest, and
    the chunk each belongs to. History before a word's start is 0."""
    symbols, of = letter_symbols(chunk_list, BITS)
    at = np.arange(len(symbols))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], symbols[:-1] == 0]), at, 0))
    place = at - start
    keys = symbols.copy()
    for back in range(1, ORDER):
        keys |= np.where(place >= back, np.roll(symbols, back), 0) << (BITS * back)
    return keys, of


#: sorted keys, the language (column) and the value of each: arrays, or the file that holds them
Source = tuple[np.ndarray, np.ndarray, np.ndarray] | str


@dataclass
class Model:
    languages: list[str]
    #: per order 1 to ORDER: discounted shares of stretches, in pieces (first key, source), sorted
    shares: list[list[tuple[int, Source]]]
    #: per order: weights of the lower order after histories, likewise
    weights: list[list[tuple[int, Source]]]
    token: str
    #: per language: the highest cross entropy that is not rejected
    limits: np.ndarray | None = None
    opened: dict[str, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def arrays(self, source: Source) -> tuple[np.ndarray, ...]:
        if not isinstance(source, str):
            return source
        if source not in self.opened:
            self.opened[source] = mapped(source)
        return self.opened[source]

    def looked_up(self, pieces: list[tuple[int, Source]], keys: np.ndarray, missing: float) -> np.ndarray:
        """Values of ``keys``, one column per language. Files without any of them are not opened."""
        out = np.full((len(keys), len(self.languages)), missing, np.float32)
        order = np.argsort(keys, kind="stable")
        wanted = keys[order]
        ends = np.append(np.searchsorted(wanted, [first for first, _ in pieces]), len(wanted))
        for (_, source), lo, hi in zip(pieces, ends, ends[1:], strict=False):
            if lo == hi:
                continue
            held, column, value = self.arrays(source)
            begin = np.searchsorted(held, wanted[lo:hi])
            count = np.searchsorted(held, wanted[lo:hi], "right") - begin
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out[np.repeat(order[lo:hi], count), column[at]] = value[at]
        return out

    def losses(self, keys: np.ndarray) -> np.ndarray:
        """Negative log probabilities of the stretches ``keys``, one column per language."""
        known, back = np.unique(keys, return_inverse=True)
        p = np.full((len(known), len(self.languages)), 1.0 / (1 << BITS), np.float32)
        for order in range(1, ORDER + 1):
            part = known & ((1 << (BITS * order)) - 1)
            p = self.looked_up(self.shares[order - 1], part, 0.0) + self.looked_up(
                self.weights[order - 1], part >> BITS, 1.0) * p
        return -np.log(p)[back]

    def compute(self, fresh: list[str]) -> list[np.ndarray]:
        """Per chunk: loss per language and the number of characters predicted."""
        keys, of = grams(fresh)
        sizes = np.bincount(of, minlength=len(fresh))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        loss = [summed(self.losses(keys[ends[lo]:ends[hi]]), sizes[lo:hi]).astype(np.float32)
                for lo, hi in slices(sizes.tolist(), self.room(_VALUES))]
        return [np.concatenate(loss), sizes.astype(np.int32)]

    def room(self, values: int) -> int:
        """How many rows of one value per language make up ``values``."""
        return max(1, values // max(1, len(self.languages)))


def mapped(uri: str) -> tuple[np.ndarray, ...]:
    """The columns of a model's file. It is mapped, not read; one on a remote file system is first
    copied to a local file without a name."""
    files, path = fs.FileSystem.from_uri(uri)
    if isinstance(files, fs.LocalFileSystem):
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
    else:
        with tempfile.NamedTemporaryFile() as local:
            with files.open_input_stream(path) as remote:
                shutil.copyfileobj(remote, local)
            local.flush()
            batch = pa.ipc.open_file(pa.memory_map(local.name)).get_batch(0)
    return tuple(batch.column(name).to_numpy() for name in ("key", "lang", "value"))


def kneser_ney(keys: np.ndarray, counts: np.ndarray):
    """Per order 1 to ORDER, from stretches and counts: (keys, shares, histories, weights)."""
    out = []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            keys, counts = np.unique(keys & ((1 << (BITS * order)) - 1), return_counts=True)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        history, of = np.unique(keys >> BITS, return_inverse=True)
        total = np.bincount(of, weights=counts)
        kinds = np.bincount(of)
        out.append((keys, (counts - discount) / total[of], history, discount * kinds / total))
    return out[::-1]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> list[tuple[int, Source]]:
    """One piece of (keys, values) per language; a value that is ``missing`` need not be held."""
    keys, values = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    column = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    kept = np.flatnonzero(values != missing)
    kept = kept[np.argsort(keys[kept], kind="stable")]
    return [(-1, (keys[kept], column[kept], values[kept].astype(np.float32)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches and counts per language: merged within the task, passed on when they grow large."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in byte_slices(texts, _SLICE):
            seen: dict[str, Counter] = {}
            for lang, text in zip(langs[lo:hi], texts[lo:hi], strict=True):
                seen.setdefault(lang, Counter()).update(chunks(text))
            for lang, counted in seen.items():
                if not counted:
                    continue
                keys, of = grams(list(counted))
                weights = np.fromiter(counted.values(), np.int64, len(counted))[of]
                parts = held.setdefault(lang, [])
                parts.append(merged([(keys, weights)]))
                size += len(parts[-1][0])
            if size > 2_000_000:
                for parts in held.values():
                    parts[:] = [merged(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1_000_000:
                    yield from flush()
                    size = 0
    yield from flush()


def _levels(counts: DataFrame) -> DataFrame:
    """Kneser-Ney counts ``lang ord gram n`` of all orders: of a stretch below the highest order, how
    many different ones a character longer end in it."""
    def ending(gram: Column, order: int) -> Column:
        return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1))

    longer = counts.select("lang", F.explode(F.array(*[
        F.struct(F.lit(o - 1).alias("ord"), ending(F.col("gram"), o).alias("gram")) for o in range(2, ORDER + 1)
    ])).alias("g")).select("lang", "g.*").distinct()
    masks = F.array(*[F.lit((1 << (BITS * o)) - 1) for o in range(1, ORDER)])
    lower = longer.groupBy("lang", "ord", F.col("gram").bitwiseAND(F.get(masks, F.col("ord") - 1)).alias("gram")).agg(
        F.count("*").alias("n"))
    return lower.unionByName(counts.select("lang", F.lit(ORDER).alias("ord"), "gram", "n"))


def _entries(levels: DataFrame, discounts: DataFrame) -> DataFrame:
    """Rows of the model, ``held key lang value``: at ``2 * (order - 1)`` the shares of stretches, at
    the odd number after it the weights of histories."""
    history = F.shiftright("gram", BITS).alias("history")
    # one history is followed by at most 1 << BITS characters
    groups = levels.groupBy("lang", "ord", history).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("gram", "n")).alias("grams"))
    base, total, discount = 2 * (F.col("ord") - 1), F.col("total"), F.col("discount")
    rows = F.concat(
        F.transform("grams", lambda g: F.struct(
            base.alias("held"), g["gram"].alias("key"), ((g["n"] - discount) / total).cast("float").alias("value"))),
        F.array(F.struct((base + 1).alias("held"), F.col("history").alias("key"),
                         (discount * F.size("grams") / total).cast("float").alias("value"))))
    named = groups.join(F.broadcast(discounts), ["lang", "ord"])  # a row per language and order
    return named.select("place", F.explode(rows).alias("r")).select("r.held", "r.key", F.col("place").alias("lang"), "r.value")


def _filed(folder: str):
    """Sorted rows of the model as one file per kind; what is given out names the files. Names are new
    in every attempt, so an attempt that is repeated leaves no half-written file behind in the model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), _ROW)
        if not rows.num_rows:
            return
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        held = rows.column("held").to_numpy()
        begins = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        out = []
        for begin, end in zip(begins, np.append(begins[1:], len(held)), strict=True):
            part = rows.slice(begin, end - begin).select(["key", "lang", "value"]).combine_chunks()
            name = f"{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(f"{path}/{name}") as stream, pa.ipc.new_file(stream, part.schema) as file:
                file.write_table(part, max_chunksize=part.num_rows)
            out.append((int(held[begin]), part.column("key")[0].as_py(), f"{folder}/{name}"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)],
            names=["held", "first", "path"])

    return run


_ROW = pa.schema([("held", pa.int32()), ("key", pa.int64()), ("lang", pa.int32()), ("value", pa.float32())])


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The models of all languages of ``train``, of all stretches in all its rows."""
    spark = train.sparkSession
    rows = columns_apart(train, [lang, text]).select(
        F.col(lang).alias("lang"), F.col(text).alias("body")).where(
        "lang IS NOT NULL AND body IS NOT NULL")
    counts = written(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    levels = written(_levels(counts), "language-levels")
    rare = levels.groupBy("lang", "ord").agg(
        F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    found = rare.collect()  # a row per language and order
    languages = sorted({r["lang"] for r in found})
    place = {name: i for i, name in enumerate(languages)}
    discounts = spark.createDataFrame(
        [(r["lang"], r["ord"], place[r["lang"]],
          r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5) for r in found],
        "lang string, ord int, place int, discount double")
    files = -(-2 * sum(r["kinds"] for r in found) // FILE_ROWS)
    placed = _entries(levels, discounts).repartitionByRange(max(1, files), "held", "key").sortWithinPartitions("held", "key")
    folder = shared_folder(spark, "language-model")
    named = sorted(placed.mapInArrow(_filed(folder), "held int, first bigint, path string").collect())
    pieces = [[(r["first"], r["path"]) for r in named if r["held"] == held] for held in range(2 * ORDER)]
    return Model(languages, pieces[::2], pieces[1::2], uuid.uuid4().hex)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        held = worker_table("language", model.token, lambda: Vocabulary(
            model.compute, min(400_000, model.room(2 * _VALUES))))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in byte_slices(texts, min(_SLICE, model.room(8 * _VALUES))):
                numbers, sizes = held.numbers(texts[lo:hi])
                if held.values:
                    loss = summed(held.values[0][numbers], sizes)
                    chars = summed(held.values[1][numbers], sizes)
                else:
                    loss, chars = np.zeros((hi - lo, len(model.languages))), np.zeros(hi - lo)
                lang, score, entropy, rejected = judged(model, loss, chars)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)],
                     pa.array(lang, pa.string()), pa.array(score), pa.array(entropy),
                     pa.array(chars.astype(np.int64)), pa.array(rejected)],
                    names=[*batch.schema.names[:-1],
                           "lang_pred", "score", "entropy", "letters", "rejected"])

    return run


def judged(model: Model, loss: np.ndarray, chars: np.ndarray):
    """Language, posterior of that language, its cross entropy, and whether the text is rejected."""
    has = (chars > 0) & bool(model.languages)
    if not model.languages:
        n = len(chars)
        return ["und"] * n, np.zeros(n), np.zeros(n), chars == 0
    per = loss / np.maximum(chars, 1)[:, None]
    best = per.argmin(axis=1)
    entropy = per[np.arange(len(per)), best]
    ahead = (per - entropy[:, None]) * np.minimum(chars, 200)[:, None]
    score = np.where(has, 1.0 / np.exp(-ahead).sum(axis=1), 0.0)
    rejected = ~has
    if model.limits is not None:
        allowance = 8.0 / np.sqrt(np.maximum(chars, 1))
        rejected = rejected | (entropy > model.limits[best] + allowance)
    names = np.array(model.languages, object)
    return list(np.where(has, names[best], "und")), score, np.where(has, entropy, 0.0), rejected


def predict(docs: DataFrame, model: Model, carried: list[Column], body: Column) -> DataFrame:
    """The columns ``carried`` with ``lang_pred score entropy letters rejected``."""
    rows = docs.select(*carried, F.coalesce(body, F.lit("")).alias("_body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages and names of files
    return rows.mapInArrow(_score(shared), with_fields(
        rows, "lang_pred string, score double, entropy double, letters long, rejected boolean"))


def calibrate(model: Model, train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Sets the limits from all texts of ``train``, whole: per language the highest cross entropy
    among them, and its distance to the median on top."""
    rows = columns_apart(train, [lang, text]).select(
        F.col(lang).alias("lang"), F.col(text).alias("body")).where("lang IS NOT NULL AND body IS NOT NULL")
    scored = predict(rows, model, [F.col("lang")], F.col("body")).where("lang = lang_pred")
    spread = {r[0]: (r[1], r[2]) for r in scored.groupBy("lang").agg(
        F.expr("percentile_approx(entropy, 0.5)"), F.max("entropy")).collect()}
    highest = max((top + (top - mid) for mid, top in spread.values()), default=np.inf)
    model.limits = np.array([
        2 * spread[k][1] - spread[k][0] if k in spread else highest
        for k in model.languages])
    return model


def trained(docs: DataFrame, training: Column) -> Model:
    train = docs.where(training & F.col("lang").isNotNull())
    return calibrate(fit(train), train)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = trained(docs, F.coalesce(~held_out, F.lit(True)))
    return predict(docs, model, [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")],
                   F.col("text"))
