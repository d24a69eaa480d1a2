"""Spelling variants: words one edit apart, by permuterm rotations.

A word with an end mark behind it, ``word$``, is turned through all its rotations. Take the rotation
that ends in a letter: what stands before that letter is the word with this letter skipped. All words
that differ from it in just that letter share this prefix (replacement), and the word without the
letter has a whole rotation equal to it (deletion, or seen from there insertion). So the near words
of all words are the groups of one key, the skipped rotation, among the range-sorted rotations. A
group has at most one word without the letter and one word per different letter: it is bounded by
the alphabet, not by the corpus. From a group each member learns how many near words it has there and
which of them is the most frequent, so no pair of words is ever written out.

A word that repeats a letter ("aab") reaches the shorter word ("ab") by several rotations; only the
first letter of such a run counts, so every near word is counted once.

Words are numbered in code-point order, so a number settles ties. A form is at least ten times as
frequent as its word, so a chain of forms is at most as long as the largest count has digits; the root
is found by doubling pointers that often.

Keys longer than ``LITERAL`` code points are replaced by their beginning, length and a 127-bit
fingerprint computed along the word, so a very long word costs memory in proportion to its length.

Defined cases: a NULL text has no words; in a row without an id no run is altered. Rows that repeat
count each. Very long texts and words are taken whole. Extra columns are ignored. An empty table has
no words and gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.functions.numbering import numbered
from shoptally.llm.common import columns_apart, table, tasks, written

#: code points of the shortest word, and how often a word must occur
SHORTEST = 7
OFTEN = 2
#: a form is so many times as frequent as its word
RATIO = 10
#: a run whose checksum is a multiple of this loses one code point
PERIOD = 31
#: code points of the longest key that is kept as text
LITERAL = 64
#: different words a task counts before it hands them on
HELD = 300_000

_END = "$"
_PRIME = (1 << 127) - 1
_BASE = 0x6A09E667F3BCC908B2FB1366EA957D3
_MARK = 0x110000  # of the end mark; no code point


#: maximal runs of letters that are long enough for a word
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def altered(doc_id, run: str, start: int) -> str:
    """The run with A to Z in lower case, or that without one code point. ``start`` is the checksum
    of ``<doc_id>:``."""
    raw = run.encode().lower()  # of bytes only A to Z change
    h = zlib.crc32(raw, start)
    word = raw.decode()
    if doc_id is None or h % PERIOD:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(_RUN.findall(text)).items():
                word = altered(doc_id, run, start)
                if len(word) >= SHORTEST:
                    held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Words and how often they occur, ``id word n``; ids are dense in code-point order."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    counts = rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return numbered(counts.where(F.col("n") >= OFTEN), ["word"], "id", 0).select("id", "word", "n")


def long_keys(word: str) -> tuple[list[str], list[str]]:
    """Keys of a long word without building its rotations: all with one letter skipped, all whole."""
    size, upto, power = len(word), [0], [1]
    for c in word:
        upto.append((upto[-1] * _BASE + ord(c) + 1) % _PRIME)
    for _ in range(size + 1):
        power.append(power[-1] * _BASE % _PRIME)

    def key(after: int, before: int) -> str:
        """Of ``word[after:] $ word[:before]``."""
        tail = (upto[size] - upto[after] * power[size - after]) % _PRIME
        whole = ((tail * _BASE + _MARK) * power[before] + upto[before]) % _PRIME
        head = (word[after:after + 16] + _END + word[:16])[:16]
        return f"{head}{_END}{_END}{size - after + 1 + before}{_END}{whole:x}"

    return [key(i + 1, i) for i in range(size)], [key(i, i) for i in range(size + 1)]


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            skipped, whole = long_keys(word)
            if len(word) <= LITERAL:  # keys with a skipped letter are text, see rotations()
                skipped = []
            first = [i == 0 or word[i] != word[i - 1] for i in range(len(skipped))]
            rows = len(skipped) + len(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(skipped + whole, pa.string()), pa.array([True] * len(skipped) + [False] * len(whole)),
                 pa.array(first + [False] * len(whole)), pa.array([number] * rows, pa.int64()),
                 pa.array([n] * rows, pa.int64())], names=["key", "skips", "first", "id", "n"])


def rotations(found: DataFrame) -> DataFrame:
    """``key skips first id n``: per word its whole rotations, and those that skip their last letter
    (``first``: not preceded by the same letter, so it stands for its run)."""
    size, place = F.length("word"), F.col("at")
    turned = found.where(size <= LITERAL).select("id", "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    before = F.substring("word", F.lit(1), place)
    skipped = turned.where(place < size).select(
        F.concat(F.substring("word", place + 2, size), F.lit(_END), before).alias("key"), F.lit(True).alias("skips"),
        (F.substring("word", place + 1, F.lit(1)) != F.substring("word", place, F.lit(1))).alias("first"),
        (place == 0).alias("starts"), "id", "n")
    skipped = skipped.select("key", "skips", (F.col("first") | F.col("starts")).alias("first"), "id", "n")
    # a whole rotation is one longer than the word
    whole = turned.where(size < LITERAL).select(
        F.concat(F.substring("word", place + 1, size), F.lit(_END), before).alias("key"), F.lit(False).alias("skips"),
        F.lit(False).alias("first"), "id", "n")
    rest = found.where(size >= LITERAL).select("id", "word", "n").mapInArrow(
        _long, "key string, skips boolean, first boolean, id bigint, n bigint")
    return skipped.unionByName(whole).unionByName(rest)


def _best(members: Column, me: Column) -> Column:
    """The most frequent of ``members`` other than ``me``, the smallest number among equals."""
    return F.array_max(F.transform(
        F.filter(members, lambda m: m["id"] != me), lambda m: F.struct(m["n"].alias("n"), (-m["id"]).alias("minus"))))


def near(found: DataFrame) -> DataFrame:
    """Per word with near words: ``id n_near form_id form_n``, the form being the most frequent one.

    The rotations are dealt out by ranges of their keys and sorted; a scan of a group's few members
    gives every one of them its count and its best partner.
    """
    dealt = rotations(found).repartitionByRange(tasks(found.sparkSession), "key").sortWithinPartitions("key")
    members = dealt.groupBy("key").agg(
        F.collect_list(F.struct("id", "n", "skips", "first")).alias("members")).where(F.size("members") > 1)
    groups = members.select(
        F.filter("members", lambda m: m["skips"]).alias("letters"),
        F.filter("members", lambda m: m["skips"] & m["first"]).alias("firsts"),
        F.filter("members", lambda m: ~m["skips"]).alias("shorter"), F.explode("members").alias("m"))
    mine = F.col("m.skips")
    others = F.when(mine, F.size("letters") - 1 + F.when(F.col("m.first"), F.size("shorter")).otherwise(0)
                    ).otherwise(F.size("firsts"))
    partner = F.when(mine, _best(F.concat("letters", "shorter"), F.col("m.id"))).otherwise(
        _best(F.col("firsts"), F.col("m.id")))
    seen = groups.select("m.id", others.alias("others"), partner.alias("best")).where("others > 0")
    return seen.groupBy("id").agg(F.sum("others").alias("n_near"), F.max("best").alias("best")).select(
        "id", "n_near", (-F.col("best.minus")).alias("form_id"), F.col("best.n").alias("form_n"))


def roots(links: DataFrame, largest: int) -> DataFrame:
    """``id root_id`` by pointer doubling over links ``id form_id``. Counts grow at least tenfold per
    step, so no chain has more steps than ``largest`` has digits."""
    steps = max(1, math.ceil(math.log(max(largest, RATIO), RATIO)))
    at = links.select("id", F.col("form_id").alias("root_id"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        at = at.join(onward, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"))
    return at


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every word with its form, root and counts: ``word form root n n_near form_n``."""
    found = words(docs, text, doc_id)
    largest = found.agg(F.max("n")).first()[0] or 1
    partners = near(found)
    known = written(found.join(partners, "id", "left"), "spelling-near")
    links = known.where(F.col("form_n") >= RATIO * F.col("n")).select("id", "form_id", "form_n")
    chains = links.join(roots(links, largest), "id")
    names = found.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = found.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = chains.join(names, "form_id").join(ends, "root_id").select("id", "form", "root", "form_n")
    return known.drop("form_id", "form_n").join(named, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(columns_apart(table(spark, sf_dir, "documents"), ["doc_id", "text"]))


#: the checksum is taken byte by byte over a table made by its rule; edits are found by deletions
SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS crc, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1
  FROM bits WHERE step < 8),
crcs AS (SELECT list(crc ORDER BY b) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i:
      (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM hexed, crcs),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m, a.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n, a.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n, b.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near,
         first(other ORDER BY m DESC, encode(other)) FILTER (m = top) AS form, max(m) AS form_n
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
linked AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM linked
  UNION ALL SELECT walk.word, l.form FROM walk JOIN linked l ON walk.at = l.word WHERE l.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN linked l ON walk.at = l.word WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN ends USING (word)
"""
