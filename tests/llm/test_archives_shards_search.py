"""WARC round trips, shards, exact search."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from messy import TEXTS, empty, table
from pyspark.sql import functions as F

from shoptally.llm import sharding as S
from shoptally.llm import top_k as K
from shoptally.llm import warc as W
from shoptally.session import shared_folder

PAGES = "page_id bigint, url string, html string, digest string, refers_to bigint, salt int"
BIG = "<p>" + "é" * 700 + "</p>"


def round_trip(spark, rows, limit=4000):
    pages = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES)
    whole, apart = shared_folder(spark, "warc-a"), shared_folder(spark, "warc-b")
    index = W.normalised(W.write(pages, whole, limit), whole, apart)
    return index, W.read(index, apart, payloads=True).collect()


def test_records_come_back(spark):
    rows = [(1, "http://a/", "short"), (2, "http://a/", "short"), (3, "u", BIG), (4, None, BIG), (5, "x\r\ny z", BIG),
            (6, "u", None), (7, "u", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 100), (9, "u", "z" * 300_000),
            (None, "u", "no id"), (None, "u", BIG), (3, "u", BIG)]
    index, got = round_trip(spark, rows)
    assert len(got) == len(rows) == index.select("archive", "offset").distinct().count()
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == raw and i is not None]
        answer = max(same) if len(raw) >= W.REVISIT_BYTES else page_id
        revisit = answer is not None and page_id != answer
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                     answer if revisit else None, None if revisit else raw))
    key = lambda r: tuple(map(repr, r))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(((*[r[f] for f in fields], r["payload"] and bytes(r["payload"]) if r["record_type"] == "response"
                    else None) for r in got), key=key) == sorted(((*w[:5], w[5] or (b"" if w[3] == "response" else None))
                                                                  for w in want), key=key)
    assert any(r["target_uri"] == "x%0D%0Ay%20z" for r in got)


def test_no_pages_no_records(spark):
    pages = spark.createDataFrame([], PAGES)
    folder = shared_folder(spark, "warc-none")
    assert W.normalised(W.write(pages, folder), folder, folder + "-b").count() == 0


def test_normaliser_reads_one_member_or_many():
    raw = [W.record(i, "u", b"p" * n, hashlib.sha1(b"p" * n).hexdigest(), None, "2024-01-01T00:00:00Z")
           for i, n in enumerate((0, 10, 200_000, 3))]
    for source in (gzip.compress(b"".join(raw)), b"".join(gzip.compress(r) for r in raw)):
        target, side = io.BytesIO(), io.BytesIO()
        rows = W.normalise(io.BytesIO(source), target, side)
        assert len(rows) == 4 and len(side.getvalue().splitlines()) == 4
        for (offset, length, *_), record in zip(rows, raw, strict=True):
            assert gzip.decompress(target.getvalue()[offset:offset + length]) == record


def test_damaged_archives_are_refused():
    raw = W.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "d")
    with pytest.raises(ValueError):
        W.normalise(io.BytesIO(gzip.compress(raw[:-6])), io.BytesIO(), io.BytesIO())
    with pytest.raises(ValueError):
        W.parsed(gzip.compress(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))


def check_shards(rows, texts, shards=16):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(4)
    texts = [f"text {i}" for i in range(700)] + [f"copy {rng.randrange(60)}" for _ in range(300)]
    rows = S.shards_of_copies(table(spark, list(enumerate(texts)))).collect()
    check_shards(rows, texts)
    homes = {}
    for r in rows:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    split = sum(len(h) > 1 for h in homes.values())
    assert split <= 20  # of 60 groups; by chance nearly all would be


def test_every_group_that_fits_a_shard_is_whole(spark):
    texts = [f"text {i}" for i in range(500)] + [f"copy {i % 37}" for i in range(350)] + ["big"] * 50 + ["hot"] * 100
    rows = S.shards_of_copies(table(spark, list(enumerate(texts)))).collect()
    check_shards(rows, texts)
    homes = {}
    for r in rows:
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert {t: len(h) for t, h in homes.items() if len(h) > 1} == {"hot": 2}


def test_seats_divide_only_what_fits_nowhere():
    whole, divided, left = S.seats([(2, 0, 7), (9, 1, 1), (30, 2, 1)], [12, 12, 12, 12, 12])
    assert divided == {(30, 2): [[[0, 12], [1, 12], [2, 6]]]}
    assert sum(n for _, n in whole[9, 1]) == 1 and sum(n for _, n in whole[2, 0]) == 7
    assert sum(left) == 60 - 30 - 9 - 14 and min(left) >= 0


def test_a_group_larger_than_a_shard_fills_neighbours(spark):
    texts = ["hot"] * 400 + [f"text {i}" for i in range(600)]
    rows = S.shards_of_copies(table(spark, list(enumerate(texts)))).collect()
    check_shards(rows, texts)


def test_shards_of_awkward_rows(spark):
    check_shards(S.shards_of_copies(table(spark)).collect(), [t for _, t in TEXTS])
    assert S.shards_of_copies(empty(spark)).count() == 0


def test_quotas_leave_no_shard_above_capacity():
    sizes, flows = {0: 100, 1: 100, 2: 40}, {(0, 1): 50, (1, 0): 10, (2, 1): 30, (0, 2): 20}
    taken = S.quotas(sizes, flows, 110)
    for s in sizes:
        after = sizes[s] + sum(taken[p] * flows[p] * ((p[1] == s) - (p[0] == s)) for p in flows)
        assert after <= 110 + 1e-6


def brute_top(rows, k):
    vectors = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[n] = (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for n, (q, v) in vectors.items():
        if q % 3 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in vectors.items()
                            if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 0, 1.0, "m") for i, v in rows],
                               "vec_id bigint, embedding array<float>, label int, score double, matrix string")
    return sorted(tuple(r) for r in K.nearest(df, F.col("vec_id") % 3 == 0, k=4, **sizes).collect())


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(90)]  # many ties
    rows += [(90 + i, [float(x) for x in rng.normal(size=24)]) for i in range(60)]
    rows += [(200, None), (201, [1.0, None] * 4), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []),
             (207, []), (None, [1.0] * 8)]
    want = brute_top(rows, 4)
    assert search(spark, rows) == want
    assert search(spark, rows, query_block=7, candidate_block=5) == want
    assert search(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(10**6 + i), float(-(10**5) * i)]) for i in range(12)]
    assert search(spark, rows) == brute_top(rows, 4)


def test_tables_of_rows_are_never_broadcast_in_sharding(spark, monkeypatch):
    texts = [f"text {i % 40}" for i in range(400)] + [f"alone {i}" for i in range(100)]
    plans, write = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, purpose: (
        plans.update({purpose: df._jdf.queryExecution().executedPlan().toString()}), write(df, purpose))[1])
    out = S.shards_of_copies(table(spark, list(enumerate(texts))))
    check_shards(out.collect(), texts)
    for purpose in ("shard-links", "shard-start", "shard-wishes", "shard-grouped", "shard-groups", "shard-order"):
        assert "BroadcastHashJoin [node" not in plans[purpose] and "BroadcastHashJoin [k1" not in plans[purpose], purpose
        assert "SortMergeJoin" in plans[purpose], purpose


def test_links_of_a_hot_row_are_spread_and_all_counted(spark, monkeypatch):
    texts = ["same"] * 300 + [f"pair {i // 2}" for i in range(100)]
    whole = [tuple(r) for r in S.shards_of_copies(table(spark, list(enumerate(texts)))).collect()]
    monkeypatch.setattr(S, "HOT", 20)
    spread = [tuple(r) for r in S.shards_of_copies(table(spark, list(enumerate(texts)))).collect()]
    assert sorted(whole, key=str) == sorted(spread, key=str)
