"""WARC archives: writing, the normaliser of monolithic gzip, and reading by index.

A writer task turns its rows into archives that are one gzip stream each. The normaliser inflates
such a stream once, piece by piece, rewrites every record as a gzip member of its own, and writes a
sidecar index of offsets, so any record can be read alone. Files lie in the cluster's shared folder;
a task's files carry a name of their own per attempt and count only through the rows the task
returns, so a repeated attempt leaves nothing but an unread file. Records are streamed: neither an
archive nor a large record is ever held whole by the normaliser.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest ``page_id`` is
a response and the others revisit it. The decision is a join on the payload's digests, spread over
salted keys, so thousands of copies of one page do not meet in one task.

Defined cases: a NULL html is an empty payload; a NULL or unprintable url is written as a URN or
percent-encoded. A NULL ``page_id`` is kept and never is the record that others refer to, unless all
ids are NULL: then all are responses. Rows that repeat id and payload of the response are responses
each. Extra columns are ignored. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.llm.common import columns_apart, filter_words, may_hold, salted, table, tasks, written
from shoptally.session import shared_folder

REVISIT_BYTES = 1000
#: an archive is closed once it holds this many bytes of records
ARCHIVE_BYTES = 32 << 20
LEVEL = 5
_PIECE = 1 << 16
_GZIP = 31
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(text: str) -> str:
    """A url as a header can hold it: control characters and blanks percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, date: str) -> bytes:
    """One record, response or revisit, as bytes with its trailing blank lines."""
    block = b"" if refers_to is not None else (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
        + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}",
                 f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _writer(folder: str, limit: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = place(folder)
        attempt, number = uuid.uuid4().hex, 0
        out = gz = name = None
        size = count = 0

        def close() -> pa.RecordBatch:
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count]},
                                              schema=pa.schema([("archive", pa.string()),
                                                                ("records", pa.int64())]))

        where.create_dir(root, recursive=True)
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"{attempt}-{number:05d}.warc.gz"
                    out = where.open_output_stream(posixpath.join(root, name), compression=None)
                    gz, size, count, number = zlib.compressobj(LEVEL, wbits=_GZIP), 0, 0, number + 1
                raw = record(page_id, url, payload, digest, refers_to, date)
                out.write(gz.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= limit:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, in pieces of bounded size."""
    gz = zlib.decompressobj(_GZIP)
    while piece := stream.read(_PIECE):
        while piece:
            yield gz.decompress(piece, _PIECE)
            piece = gz.unconsumed_tail
            if gz.eof:
                piece = gz.unused_data
                gz = zlib.decompressobj(_GZIP)
    yield gz.flush()


class Pieces:
    """Reads a stream of pieces up to a mark or for a number of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Everything before ``mark``; None at the end of the stream."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        found, self.held = self.held[:at], self.held[at + len(mark):]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def normalise(source, target, sidecar) -> list[tuple[int, int, str, str]]:
    """Rewrites the archive ``source`` to ``target`` with one gzip member per record and writes the
    sidecar's lines. Returns (offset, length, record id, type) per record."""
    rows, offset, pieces = [], 0, Pieces(inflated(source))
    while (head := pieces.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        named = fields(head)
        gz, begin = zlib.compressobj(LEVEL, wbits=_GZIP), offset

        def put(raw: bytes) -> None:
            nonlocal offset
            if raw:
                target.write(raw)
                offset += len(raw)

        put(gz.compress(head + b"\r\n\r\n"))
        for part in pieces.take(int(named["content-length"]) + 4):
            put(gz.compress(part))
        put(gz.flush())
        rows.append((begin, offset - begin, named["warc-record-id"], named["warc-type"]))
        sidecar.write(f"{rows[-1][0]} {rows[-1][1]} {rows[-1][2]} {rows[-1][3]}\n".encode())
    return rows


def _normaliser(source: str, target: str):
    kinds = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                       ("record_id", pa.string()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = place(source)
        there, goal = place(target)
        there.create_dir(goal, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                path = posixpath.join(goal, new)
                with (where.open_input_stream(posixpath.join(root, name), compression=None) as old,
                      there.open_output_stream(path, compression=None) as out,
                      there.open_output_stream(f"{path}.index", compression=None) as side):
                    rows = normalise(old, out, side)
                at, length, ids, types = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new] * len(rows), pa.string()), pa.array(at, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(types, pa.string())], schema=kinds)

    return run


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member; a response's payload must match its digest."""
    head, _, rest = zlib.decompress(member, _GZIP).partition(b"\r\n\r\n")
    named = fields(head)
    payload = rest[:int(named["content-length"])].partition(b"\r\n\r\n")[2]
    if named["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
        if named["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"{named['warc-record-id']}: payload does not match its digest")
    return named, payload


def _reader(folder: str, payloads: bool):
    kinds = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
        *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = place(folder)
        name = source = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out = {f.name: [] for f in kinds}
                for row in batch.slice(begin, 256).to_pylist():
                    if row["archive"] != name:
                        if source is not None:
                            source.close()
                        name = row["archive"]
                        source = where.open_input_file(posixpath.join(root, name))
                    source.seek(row["offset"])
                    named, payload = parsed(source.read(row["length"]))
                    digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = named["warc-type"] == "response"
                    page, refers = named["x-page-id"], named.get("x-refers-to-page")
                    values = [int(page) if page else None,
                              len(payload) if whole else int(named["x-payload-length"]), digest,
                              named["warc-type"], int(refers) if refers else None,
                              named["warc-target-uri"], payload if whole else None]
                    for field, value in zip(kinds, values, strict=False):
                        out[field.name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)
        if source is not None:
            source.close()

    return read


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id url payload digest refers_to`` per page."""
    rows = columns_apart(pages, ["page_id", "url", "html"]).select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("other", F.xxhash64("payload"))  # besides the digest, against forged ones
    keys = ["digest", "size", "other"]
    repeated = (
        rows.where(F.col("size") >= least).groupBy(*keys)
        .agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    repeated = written(repeated, "warc-repeated")
    # only pages that may be repeated are moved for the join; the filter's size is fixed
    shared = pages.sparkSession.sparkContext.broadcast(filter_words(repeated, "other"))
    rows = rows.withColumn("maybe", may_hold(shared, F.col("other")))
    refers = F.when(F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer")),
                    F.col("answer"))
    joined = salted(rows.where("maybe"), repeated, keys, F.col("page_id"), "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to"))
    alone = rows.where("NOT maybe").select(
        "page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    return alone.union(joined)


def write(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` as monolithic archives into ``folder``: ``archive records`` per file."""
    rows = with_revisits(pages)
    return written(rows.mapInArrow(_writer(folder, limit, date), "archive string, records long"),
                   "warc-archives")


def normalised(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites ``archives`` of ``source`` into ``target``; the index, one row per record."""
    spread = archives.select("archive").repartition(tasks(archives.sparkSession))
    return written(spread.mapInArrow(
        _normaliser(source, target),
        "archive string, offset long, length long, record_id string, record_type string"),
        "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records named by ``index``, each read alone at its offset."""
    more = ", payload binary" if payloads else ""
    return index.select("archive", "offset", "length").mapInArrow(
        _reader(folder, payloads),
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, target_uri string" + more)


def op7(spark, sf_dir: str) -> DataFrame:
    whole, apart = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc-apart")
    archives = write(table(spark, sf_dir, "pages"), whole)
    back = read(normalised(archives, whole, apart), apart)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
b AS (SELECT page_id, payload, octet_length(encode(payload))::BIGINT AS payload_bytes FROM p),
a AS (SELECT payload, max(page_id) AS answer FROM b WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT b.page_id, payload_bytes, sha1(b.payload) AS payload_digest,
       CASE WHEN answer <> b.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN answer <> b.page_id THEN answer END AS refers_to
FROM b LEFT JOIN a ON a.payload = b.payload
"""
