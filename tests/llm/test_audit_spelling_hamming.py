"""Filter audit, spelling variants and the Hamming index against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from messy import LONG, TEXTS, empty, table
from pyspark.sql import functions as F

from shoptally.llm import filter_audit as A
from shoptally.llm import hamming as H
from shoptally.llm import spelling as S

# ---- filter audit


def failing(rows):
    """Set of filters each (doc_id, text) fails, from the contract's words."""
    out = []
    for doc_id, text in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        same = [i for i, t in rows if (t or "") == body and i is not None and doc_id is not None and i < doc_id]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body),
                 "D": bool(re.search(r"[#$%&*|]", body)), "E": bool(same)}
        out.append({f for f, x in fails.items() if x})
    return out


def audit_by_hand(rows, parts, labels):
    fails, out, marks = failing(rows), {}, {}
    for i, q, t in labels:
        if i is not None:
            marks[i] = (marks.get(i, (0, 0))[0] or int(q == 1), marks.get(i, (0, 0))[1] or int(t == 1))
    for part in set(parts):
        docs = [(f, marks.get(r[0], (0, 0))) for f, r, p in zip(fails, rows, parts, strict=True) if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                now, before = order[step - 1], set(order[:step - 1])
                gone = [(f, m) for f, m in docs if now in f and not f & before]
                out[part, order, step] = (
                    sum(not f & (before | {now}) for f, _ in docs), len(gone),
                    sum(now in f and bool(f & before) for f, _ in docs), sum(f == {now} for f, _ in docs),
                    sum(m[0] for _, m in gone), sum(m[1] for _, m in gone))
    totals = Counter()
    for (part, order, step), v in out.items():
        totals[part, order[step - 1]] += v[1]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_awkward_rows_against_brute_force(spark):
    rng = random.Random(5)
    texts = [*TEXTS, (20, "ABC " * 60), (21, "a#b " + " ".join(map(str, range(60)))), (22, "ABC " * 60), (21, None),
             *[(30 + i, " ".join(rng.choice("abcdefgh|X") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))))
               for i in range(60)]]
    parts = [[None, "", "x", "y"][i % 4] for i in range(len(texts))]
    docs = spark.createDataFrame(
        [(i, t, p, "k", 1, 2, 3) for (i, t), p in zip(texts, parts, strict=True)],
        "doc_id bigint, text string, source string, part string, n int, digest int, kept int")
    labels = [(20, 1, 0), (20, 0, 1), (1, 1, 1), (None, 1, 1), (999, 1, 1), (33, None, 1), (21, 0, 0)]
    got = A.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got.collect()} == audit_by_hand(
        texts, [p or "" for p in parts], labels)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert A.audit(empty(spark), none).count() == 0


@pytest.mark.parametrize("limit", [40, A.SHARD_CHARS])
def test_matrix_holds_every_word_count(spark, limit):
    csr, names = A.matrix(table(spark), [F.col("doc_id")], limit=limit)
    words = {r["id"]: bytes(r["word"]).decode() for r in names.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    got = []
    for r in csr.collect():
        ends, cols = np.frombuffer(r["ends"], np.int64), np.frombuffer(r["columns"], np.int64)
        counts = np.frombuffer(r["counts"], np.int32)
        for doc, a, b in zip(r["docs"], ends[:-1], ends[1:], strict=True):
            got.append((doc["kept"]["doc_id"], {words[c]: int(n) for c, n in zip(cols[a:b], counts[a:b], strict=True)}))
    want = [(i, dict(Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t in TEXTS]
    assert sorted(map(repr, ((i, sorted(w.items())) for i, w in got))) == sorted(
        map(repr, ((i, sorted(w.items())) for i, w in want)))


# ---- spelling variants


def variants_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def check_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id bigint, text string, n int, id int, key string")
    got = [tuple(r) for r in S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == variants_by_hand(rows)
    return {g[0]: g for g in got}


def test_variants_against_brute_force(spark):
    rng = random.Random(11)
    base = ["abcdefgh", "aabbccdd", "aaaaaaa", "übergröße", "straßenbahn", "xyxyxyxyx"]

    def edited(w):
        i, c = rng.randrange(len(w) + 1), rng.choice("abxyßü÷")
        return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])

    words = [w for w in base for _ in range(300)] + [edited(rng.choice(base)) for _ in range(2500)]
    words += [edited(edited(rng.choice(base))) for _ in range(1500)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "Abcdefgh ABCDEFGH ÀBCDEFGH"), (1, None), (2, "")]
    found = check_variants(spark, rows)
    assert sum(g[1] is not None for g in found.values()) > 50 and any(g[1] not in (None, g[2]) for g in found.values())


def test_variants_of_long_words(spark):
    """Around the length where keys change, and words far beyond."""
    rng = random.Random(3)
    rows = []
    for size in (62, 63, 64, 65, 66, 3000):
        w = "".join(rng.choice("abc") for _ in range(size))
        rows += [(None, f"{w} {w} " * 20), (None, f"{w[1:]} {w[:-1]}x {w[:9]}q{w[9:]} " * 2), (None, f"{w[:40]}{w[41:]} " * 2)]
    assert any(g[4] > 2 for w, g in check_variants(spark, rows).items() if len(w) == 3000)


def test_variants_of_awkward_rows(spark):
    got = {tuple(r) for r in S.variants(table(spark)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_hand(TEXTS)
    assert S.variants(empty(spark)).count() == 0
    assert S.variants(spark.createDataFrame([(1, LONG.replace("word", "words"))] * 3, "doc_id bigint, text string")).count() == 0


def test_keys_of_long_words_are_those_of_their_rotations():
    word = "abcabdabc" * 9
    skipped, whole = S.long_keys(word)
    shorter, longer = word[:30] + word[31:], word[:30] + "x" + word[30:]
    assert skipped[30] == S.long_keys(shorter)[1][30] and S.long_keys(longer)[0][30] == whole[30]
    assert len(set(whole)) == len(word) + 1


# ---- multi-index hashing


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code int, v int")


def test_every_code_within_the_radius_is_found_once():
    rng = np.random.default_rng(2)
    q = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    c = np.concatenate([q[rng.integers(0, 40, 500)] ^ sum(
        np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64) for _ in range(9)), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    far = np.bitwise_count(q[:, None] ^ c[None, :])
    for radius in (0, 3, 9, 22, 30, 64):
        pairs = Counter()
        for j in range(H.SUBSTRINGS):
            order = np.argsort((c >> np.uint64(16 * j)) & np.uint64(0xFFFF), kind="stable")
            rows, cols = H.within(q, c[order], j, radius)
            pairs.update(zip(rows.tolist(), order[cols].tolist(), strict=True))
        assert set(pairs) == set(zip(*[x.tolist() for x in np.nonzero(far <= radius)], strict=True))
        assert not pairs or max(pairs.values()) == 1
        assert sum(s + 1 for s in H.shares(radius)) == radius + 1


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[query])**2).sum(axis=1))
    others = [i for i in range(len(ids)) if ids[i] != ids[query]]
    return sorted((d[i], ids[i]) for i in others)[:k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 32))
    x = (middle[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32)) * 0.7).astype(np.float32)
    x[1000:2000] = x[1000]  # one vector that a third of the rows share
    ids = list(range(3000))
    got = {}
    for r in H.nearest(vectors(spark, [(i, v.tolist(), 0, 1, 2) for i, v in zip(ids, x, strict=True)]),
                       F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 50))
    hit, wide = 0, x.astype(np.float64)
    for query, found in got.items():
        found.sort()
        want = brute(ids, wide, query)
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == np.sqrt(((wide[query] - wide[v])**2).sum())
        if 1000 <= query < 2000:  # all at distance 0: ties go to the smaller ids
            assert [v for _, v, _ in found] == [w[1] for w in want]
        hit += len({w[1] for w in want} & {f[1] for f in found})
    assert hit >= 0.9 * 10 * len(got)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0, 3.0], 0, 1, 2), (100, [1.0, 2.0, 4.0], 0, 1, 2), (3, [0.0, 0.0, 0.0], 0, 1, 2),
            (4, None, 0, 1, 2), (5, [1.0, None, 2.0], 0, 1, 2), (6, [float("nan"), 1.0, 1.0], 0, 1, 2),
            (7, [float("inf"), 1.0, 1.0], 0, 1, 2), (8, [], 0, 1, 2), (None, [1.0, 2.0, 3.0], 0, 1, 2),
            (9, [5.0, 2.0, 3.0], 0, 1, 2), (9, [1.0, 2.0, 3.5], 0, 1, 2), (10, [1.0, 2.0], 0, 1, 2),
            (200, [1.0, 9.0], 0, 1, 2), (300, [7.0], 0, 1, 2)]
    got = sorted(tuple(r) for r in H.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 9, 0.5), (0, 2, 100, 1.0), (0, 3, 9, 4.0),
                   (100, 1, 9, 0.5), (100, 2, 0, 1.0), (100, 3, 9, np.sqrt(17.0)), (200, 1, 10, 7.0)]
    assert H.nearest(vectors(spark, rows[:0]), F.col("vec_id") % 100 == 0).count() == 0


def test_audit_broadcasts_neither_labels_nor_texts(spark):
    docs = spark.createDataFrame([(i, f"some text {i % 50}", "s") for i in range(200)], "doc_id bigint, text string, source string")
    labels = A.written(spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int"), "labels")
    plan = A.audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("doc_id" in line or "digest" in line)]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins), joins
