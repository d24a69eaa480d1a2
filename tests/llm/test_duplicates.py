"""Exact and near duplicates against brute force, and their indexes."""

import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from messy import LONG, TEXTS, empty, table
from pyspark.sql import functions as F

from shoptally.llm import common
from shoptally.llm import exact_dedup as X
from shoptally.llm import near_dedup as N


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_of_awkward_rows(spark):
    got = sorted(map(tuple, X.groups(table(spark)).collect()), key=repr)
    want = []
    for i, text in TEXTS:
        same = [j for j, t in TEXTS if plain(t) == plain(text)]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(plain(text).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_survivors_keep_all_columns(spark):
    out = X.survivors(table(spark))
    assert out.columns == table(spark).columns
    kept = Counter(plain(r["text"]) for r in out.collect())
    assert set(kept.values()) == {1} and set(kept) == {plain(t) for _, t in TEXTS}
    assert X.groups(empty(spark)).count() == 0 and X.survivors(empty(spark)).count() == 0


def test_white_space_pattern_is_the_contracts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85ab") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["body"] for r in X.fingerprints(df).select("doc_id", "body").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_directory_doubles_until_buckets_fit():
    loads = {0: 90, 1: 10, 2: 10, 3: 10, 8: 30, 15: 30}
    depth, entries, local = X.doubled(loads, 4, 50)
    assert len(entries) == 2**depth and depth == 4  # range 0 alone is overfull, and cannot split
    held = Counter()
    for slot, load in loads.items():
        held[entries[slot >> (4 - depth)]] += load
    assert all(n <= 50 or local[b] == 4 for b, n in held.items())
    assert X.doubled({}, 4, 50) == (0, [0], [0])


def test_collisions_are_told_apart_by_bytes(spark):
    import pyarrow as pa

    names = ["bucket", "key", "sha", "body", "keep_id", "n"]
    rows = [(0, 5, b"a", "x", 3, 2), (0, 5, b"b", "y", 1, 1), (0, 5, b"a", "x", 2, 1), (0, 9, b"c", "z", None, 1)]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*part), [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()])],
        names=names) for part in (rows[:2], rows[2:])]
    out = [tuple(r.values()) for b in X._own(iter(batches)) for r in b.to_pylist()]
    assert sorted(out, key=repr) == [(0, 5, b"a", 0, 2, 3), (0, 5, b"b", 1, 1, 1), (0, 9, b"c", 0, None, 1)]


def test_many_small_buckets(spark):
    rows = [(i, f"text {i % 400} " + "y" * 50) for i in range(2000)]
    got = {r["doc_id"]: r["keep_id"] for r in
           X.build(table(spark, rows), capacity=1000)[0].selectExpr("keep_id AS doc_id", "keep_id").collect()}
    assert sorted(got) == list(range(400))


def words(text):
    return [w for w in ("".join(filter(str.isalnum, c.lower())) for c in (text or "").split()) if w]


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def brute_classes(rows):
    vectors = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            low, high = sum((vectors[a] & vectors[b]).values()), sum((vectors[a] | vectors[b]).values())
            if high and low / high >= 0.8:
                parent[find(a)] = find(b)
    members = {}
    for a, (i, _) in enumerate(rows):
        members.setdefault(find(a), []).append(i)
    return sorted((min((j for j in m if j is not None), default=None), len(m)) for m in members.values() for _ in m)


def near_rows():
    """Families of copies with edits: a few words of 120 changed, or so many that they are no copies."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, number = [], 100
    for family in range(12):
        base = text(120)
        for copy in range(8):
            own = list(base)
            for _ in range(1 if copy < 6 else 30):
                own[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
            rows.append((number, " ".join(own)))
            number += 1
    return rows + [(number + i, " ".join(text(80))) for i in range(30)]


def test_near_classes_against_brute_force(spark):
    rows = near_rows()
    got = N.classes(table(spark, rows)).collect()
    assert sorted((r["class_id"], r["class_size"]) for r in got) == brute_classes(rows)


def test_a_bucket_of_many_classes_is_decided_exactly(spark):
    """All texts share all buckets, as pages of one template do: more classes than centres are tried."""
    rows = near_rows()
    docs = table(spark, rows)
    idf = spark.sparkContext.broadcast(N.frequencies(docs))
    signed = N.signatures(docs, idf, "text", "doc_id").withColumn("bands", F.expr("sequence(1L, 9L)"))
    ids = {r["node"]: r["doc_id"] for r in signed.collect()}
    classes = {}
    for r in N.components(N.links(docs, signed, idf, "text")[1]).collect():
        classes.setdefault(r["root"], []).append(ids[r["node"]])
    got = sorted((min(m), len(m)) for m in classes.values() for _ in m)
    assert got == [c for c in brute_classes(rows) if c[1] > 1]


def vectors_of(spark, kinds):
    return spark.createDataFrame(
        [(n, bytearray(k.astype(np.uint64).tobytes()), bytearray(np.ones(len(k), np.float32).tobytes()))
         for n, k in enumerate(kinds)], "node bigint, kinds binary, weights binary")


def test_equal_vectors_of_many_roots_end_in_one_class(spark):
    vectors = vectors_of(spark, [np.arange(1, 11) << 50] * 80)
    found = N.finer_links(vectors.selectExpr("node", "node div 2 AS root"), vectors, 0.8).collect()
    assert all(r["a"] // 2 != r["b"] // 2 for r in found)
    links = [(r["a"], r["b"]) for r in found] + [(2 * i, 2 * i + 1) for i in range(40)]
    roots = N.components(spark.createDataFrame(links, "a bigint, b bigint")).select("root").distinct().collect()
    assert [r["root"] for r in roots] == [0]


def test_links_of_pages_of_one_template(spark):
    """Pages of one template, 0.5 to 0.99 alike: pairs of 0.8 and more end in one class."""
    rng = np.random.default_rng(4)
    template = np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64))
    kinds = []
    for n in range(150):
        own = template.copy()
        own[rng.choice(len(own), 1 + n % 40, replace=False)] = rng.integers(1, 1 << 63, 1 + n % 40, dtype=np.uint64)
        kinds.append(np.unique(own))
    vectors = vectors_of(spark, kinds)
    links = N.finer_links(vectors.selectExpr("node", "node AS root"), vectors, 0.8)
    found = links.collect()
    alike = lambda a, b: N.similarity(*((k, np.ones(len(k))) for k in (kinds[a], kinds[b])))
    assert found and all(alike(r["a"], r["b"]) >= 0.8 for r in found)
    roots = {r["node"]: r["root"] for r in N.components(links).collect()}
    for least, recall in ((0.8, 0.9), (0.85, 0.97), (0.9, 0.99)):
        close = [(a, b) for b in range(len(kinds)) for a in range(b) if alike(a, b) >= least]
        assert sum(roots.get(a, -1) == roots.get(b, -2) for a, b in close) >= recall * len(close)


def test_centres_go_only_where_their_bucket_needs_them(spark):
    rows = [(0, v, 2, 2 * v + i) for v in range(300) for i in range(2)] + [(1, 7, 1000, 5000 + i) for i in range(1000)]
    met = spark.createDataFrame(rows, "band int, value bigint, n bigint, node bigint")
    centre = met.where("node % 2 = 0 AND (band = 0 OR node < 5006)").withColumnRenamed("node", "a")
    out = N.met_centres(met, centre)
    got = Counter((r["band"], r["a"]) for r in out.collect())
    assert got == Counter({(0, 2 * v): 2 for v in range(300)} | {(1, 5000 + 2 * i): 1000 for i in range(3)})
    assert N.repeated(centre).count() == 300 + 3 * 4


def test_an_outline_never_tells_less_than_the_vectors():
    rng = np.random.default_rng(6)
    pool = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    for size in (1, 5, 300):
        for _ in range(60):
            a, b = ((np.unique(k), None) for k in (rng.choice(pool, size), rng.choice(pool, size)))
            a, b = ((k, (rng.integers(1, 90_000, len(k)) * rng.uniform(1, 1.1, len(k))).astype(np.float32)) for k, _ in (a, b))
            seen = N.similarity(*(N.outline(*(x.tobytes() for x in N.folded(*v))) for v in (a, b)))
            assert seen >= N._OUTLINE * N.similarity(a, b)
            assert sum(x.nbytes for x in N.folded(*a)) <= 4 * len(a[0])


def test_texts_without_a_possible_partner_are_decided_early(spark):
    rng = np.random.default_rng(5)
    shared = np.unique(rng.integers(1, 1 << 63, 70, dtype=np.uint64))
    kinds = [np.unique(np.concatenate([shared, rng.integers(1, 1 << 63, 30, dtype=np.uint64)])) for _ in range(40)]
    vectors = vectors_of(spark, [*kinds, shared, shared[:65]])
    rest = vectors.selectExpr("node", "node AS root")
    assert {r["node"] for r in N.finer(rest, vectors, 0.8).collect()} == {40, 41}
    assert {(r["a"], r["b"]) for r in N.finer_links(rest, vectors, 0.8).collect()} == {(40, 41)}
    assert N.finer_links(rest.limit(0), vectors, 0.8).count() == 0


def test_near_classes_of_awkward_rows(spark):
    got = N.classes(table(spark)).collect()
    assert len(got) == len(TEXTS)
    ids = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got if r["doc_id"] is not None}
    assert ids[1] == ids[2] == ids[3] == (1, 3) and ids[9] == ids[10] == (9, 2) and ids[14] == (14, 2)
    assert all(ids[i] == (i, 1) for i in (4, 5, 6, 7, 8, 11, 12, 13))
    out = N.survivors(table(spark))
    assert out.columns == table(spark).columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14]
    assert out.where("doc_id IS NULL").count() == 2
    assert N.classes(empty(spark)).count() == 0 and N.survivors(empty(spark)).count() == 0


def test_near_survivors_of_texts_under_one_id(spark):
    rows = [(1, "one text of some words here"), (1, "quite another text than the first"), (1, None), (1, None), (2, "")]
    assert sorted((r["doc_id"], r["text"] or "") for r in N.survivors(table(spark, rows)).collect()) == sorted(
        (i, t or "") for i, t in rows)


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_samples_agree_as_often_as_weights_are_similar(share):
    rng = np.random.default_rng(2)
    draw = N.Sampler(samples=600)
    common = rng.integers(1, 1 << 63, int(2000 * share), dtype=np.uint64)
    own = [rng.integers(1, 1 << 63, 2000 - len(common), dtype=np.uint64) for _ in range(2)]
    vectors = []
    for mine in own:
        kinds = np.unique(np.concatenate([common, mine]))
        vectors.append((kinds, 1.0 + (kinds % np.uint64(3)).astype(float)))
    a, b = (draw.samples(*v) for v in vectors)
    assert abs((a == b).mean() - N.similarity(*vectors)) < 0.08


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(300, 301)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


def test_links_are_written_by_few_tasks(spark, monkeypatch):
    parts, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name: (parts.append(df.rdd.getNumPartitions()), write(df, name))[1])
    wide = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wide}
    try:
        for name, value in wide.items():
            spark.conf.set(name, value)
        links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (52, 51)], "a long, b long")
        got = {r["node"]: r["root"] for r in N.components(links).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50, 52: 50}
    assert max(parts) <= max(4 * spark.sparkContext.defaultParallelism, 211 // 8)


@pytest.mark.parametrize("run", [N._verify(0.8, N.exact), N._finer(SimpleNamespace(value=None), 0.8), N._posted, N._outlines])
def test_tasks_that_read_no_text_keep_no_words(run):
    list(N.shingles(["one two three four five six"]))
    assert "words" in common._TABLES
    list(run(iter([])))
    assert not common._TABLES


def test_whole_texts_count():
    """Texts that differ at their ends only, beyond any prefix."""
    other = " ".join(LONG.split()[:-20_000] + [f"z{i}" for i in range(20_000)])
    a, b = (N.weighted(next(iter(N.shingles([t]))), np.ones(1 << N.CELLS, np.float32)) for t in (LONG, other))
    assert N.similarity(a, b) < 0.8


@pytest.mark.parametrize("survivors", [X.survivors, N.survivors])
def test_survivors_keep_columns_of_any_name(spark, survivors):
    names = ["_key", "_sha", "_keep", "_a", "_b", "_own", "_id", "_k1", "_alone", "row", "key", "sha", "id", "k", "s", "a",
             "b", "alone", "keep", "_first"]
    rows = [(i, t, *[f"{n}-{i}" for n in names]) for i, t in
            [(1, "one two three four five six"), (2, "one two three four five six"), (3, "quite another text of some words"), (4, "")]]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = survivors(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[0] != 2]
