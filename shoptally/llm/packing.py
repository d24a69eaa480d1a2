"""Packing: all documents' tokens in one line, cut into sequences of equal length.

Pass one tokenises every text once and writes ids, with their number and the number of tokens that
stand before a document in its partition. The totals per partition are summed up, without the ids, to
the partitions' places in the whole line (one row per partition). Pass two adds both, so each document knows its place, and cuts it
where a window of ``length`` tokens ends. A piece is one boundary record: which stretch of which
document stands where in which sequence. Only the last sequence needs padding. No task ever holds
more than a batch of texts, and a document's length does not matter.

Tokens come from the tokenizer's own normaliser and model. Nothing in them reaches across white
space, so ids are looked up once per different chunk between white space of a slice of texts, and kept
in a cache of bounded size.

Defined cases: a NULL text is empty: its one token is the end mark. Rows that repeat an id, or have
none, are documents of their own. Extra columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoptally.llm.common import chunks, columns_apart, slices, table, without_tables, worker_table, written

LENGTH = 2048
#: id 1 ends every document
END_ID = 1
#: chunks whose ids one Python worker keeps
CACHED = 500_000
#: bytes of text tokenised at a time
_SLICE = 1 << 22
_LATIN = "\u024f"
#: Latin letters beyond ASCII that lower-casing alone normalises, within their own range
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
#: the vocabulary's words in a lower-cased chunk of such letters and printable ASCII
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}]+")


class ChunkIds(dict):
    """Ids of chunks of text as unsigned 32-bit bytes, the most recent ones kept."""

    def __init__(self, path: str, limit: int = CACHED):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.steps = self.tokenizer.pre_tokenizer
        self.half, self.older = limit // 2, {}
        self.letters = "".join(byte_letters())
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.ids(chunk)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, chunk: str) -> bytes:
        if "<|" in chunk:  # may hold a special token
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.fullmatch(chunk):
            text = chunk.lower()
            words = [text] if text.isalpha() else _WORDS.findall(text)
        else:
            text = self.normalizer.normalize_str(chunk)
            if not text.isprintable() or max(text) > _LATIN:
                # what is a letter there depends on the library's edition of Unicode: ask the tokenizer
                words = [w for w, _ in self.steps.pre_tokenize_str(text)]
                return b"".join([self.word(w) for w in words])
            words = [text] if text.isalpha() else self.split.findall(text)
        if words != [chunk]:
            return b"".join([self[w] for w in words])
        return self.word(text if text.isascii() else codecs.charmap_decode(text.encode(), "strict", self.letters)[0])

    def word(self, letters: str) -> bytes:
        """The ids of one word, given in the vocabulary's letters for bytes."""
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        return b"".join([self[c] for c in chunks(text)])

    def encoded(self, texts: pa.Array, end: bytes) -> tuple[pa.Array, np.ndarray]:
        """The ids of whole texts, ``end`` behind each, and their numbers. Arrow cuts the texts and numbers
        their different chunks, so each of these is looked up once."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # white space to Arrow
            parts = pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            parts = pc.utf8_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        ids = [self[c] if c else b"" for c in coded.dictionary.to_pylist()]
        stops = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
        found = np.insert(coded.indices.to_numpy(), stops, len(ids))
        laid = pa.array([*ids, end], pa.large_binary()).take(pa.array(found))
        bounds = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)
        bounds = np.concatenate([[0], bounds[stops + np.arange(1, len(stops) + 1)]])
        whole = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), laid.buffers()[2]])
        return whole, np.diff(bounds) // 4


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes follow in order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def encoder(path: str) -> ChunkIds:
    """One encoder per Python worker and vocabulary."""
    return worker_table("packing", path, lambda: ChunkIds(path))


def _tokenise(path: str, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, part, before = encoder(path).encoded, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        kinds = pa.schema([("doc_id", id_type), ("part", pa.int64()), ("before", pa.int64()),
                           ("size", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), _SLICE):
                ids, sizes = encoded(texts.slice(lo, hi - lo), end)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part)),
                     pa.array(starts), pa.array(sizes), ids.cast(pa.binary())], schema=kinds)

    return run


def tokens(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """Pass one, written: ``doc_id part before size ids`` (unsigned little-endian 32-bit ids)."""
    rows = columns_apart(docs, [doc_id, text]).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("body"))
    return written(rows.mapInArrow(
        _tokenise(path, end_id, pa.int64()), "doc_id long, part long, before long, size long, ids binary"),
        "packing-tokens")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        without_tables()
        for batch in batches:
            ids, place = batch.column(2).cast(pa.large_binary()), batch.column(1).to_numpy()
            bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
            total, data = np.diff(bounds) // 4, memoryview(ids.buffers()[2] or b"")
            first = place // length
            count_of = np.where(total > 0, (place + total - 1) // length - first + 1, 0)
            row = np.repeat(np.arange(len(place)), count_of)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count_of) - count_of, count_of)
            at = np.maximum(sequence * length, place[row])
            size = np.minimum((sequence + 1) * length, (place + total)[row]) - at
            begin = at - place[row]
            byte = bounds[row] + 4 * begin
            crcs = [zlib.crc32(data[lo:hi]) for lo, hi in zip(byte.tolist(), (byte + 4 * size).tolist(), strict=True)]
            columns = [begin, size, crcs, total[row], sequence, at - sequence * length]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]],
                names=names)

    return run


def places(passed: DataFrame) -> DataFrame:
    """Where every partition's tokens begin in the whole line: ``part start``."""
    totals = passed.groupBy("part").agg(F.max(F.col("before") + F.col("size")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``."""
    passed = tokens(docs, path, end_id, text, doc_id)
    placed = passed.join(F.broadcast(places(passed)), "part")  # one row per partition
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("place"), "ids").mapInArrow(
        _cut(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
