"""Language and toxicity models: exact sums, gradients, held-out accuracy, awkward rows."""

import math
import random

import numpy as np
import pyarrow as pa
from messy import TEXTS, empty, table
from pyspark.sql import functions as F

from shoptally.llm import language as L
from shoptally.llm import toxicity as T

ALPHABET = {"aa": "abcde", "bb": "vwxyz", "cc": "aevwk"}


def sentence(rng, lang, n=60):
    return " ".join("".join(rng.choice(ALPHABET[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(spark, per=60):
    rng = random.Random(5)
    rows = [(lang, sentence(rng, lang)) for lang in ALPHABET for _ in range(per)]
    return spark.createDataFrame(
        [(i, t, lang, "s", None) for i, (lang, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_probabilities_of_all_characters_sum_to_one():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"] * 3), pa.array(["abc abd", "bca dab", "ab ab ac"])], names=["l", "t"])
    out = list(L._count(iter([batch])))
    keys = np.concatenate([b.column(1).to_numpy() for b in out])
    counts = np.concatenate([b.column(2).to_numpy() for b in out])
    order = np.argsort(keys)
    levels = L.kneser_ney(keys[order], counts[order])
    model = L.Model(["aa"], [L._merged([(x[0], x[1])], 0.0) for x in levels],
                    [L._merged([(x[2], x[3])], 1.0) for x in levels], "t")
    for history in (0, ord("a") << 12, ord("b") << 12 | ord("a") << 24, ord("z") << 12):
        every = np.arange(1 << 12, dtype=np.int64) | history
        assert abs(np.exp(-model.losses(every)).sum() - 1) < 1e-3


def test_counts_cover_whole_texts():
    text = "abc " * 50_000
    out = list(L._count(iter([pa.RecordBatch.from_arrays([pa.array(["aa"]), pa.array([text])], names=["l", "t"])])))
    assert sum(b.column(2).to_pylist()[i] for b in out for i in range(b.num_rows)) == 4 * 50_000


def test_every_stretch_and_language_is_learned(spark):
    rng = random.Random(3)
    rows = [("aa", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(600)))
            for _ in range(60)]
    rows += [(f"l{i}", f"w{chr(0x250 + i)}rd {chr(0x250 + i)} {sentence(rng, 'bb', 5)}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = L.fit(docs)
    assert model.languages == sorted({lang for lang, _ in rows})
    levels, every = [], {}
    for name in model.languages:
        batch = pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([t if own == name else "" for own, t in rows])], names=["l", "t"])
        out = pa.Table.from_batches(L._count(iter([batch])))
        order = np.argsort(out.column(1).to_numpy())
        every[name] = out.column(1).to_numpy()[order]
        levels.append(L.kneser_ney(every[name], out.column(2).to_numpy()[order]))
    assert len(every["aa"]) > 100_000
    for own, places in ((model.shares, (0, 1)), (model.weights, (2, 3))):
        for o in range(L.ORDER):
            held = sum(len(model.arrays(source)[0]) for _, source in own[o])
            assert held == sum(len(lv[o][places[0]]) for lv in levels)
    whole = L.Model(model.languages, [L._merged([(lv[o][0], lv[o][1]) for lv in levels], 0.0) for o in range(L.ORDER)],
                    [L._merged([(lv[o][2], lv[o][3]) for lv in levels], 1.0) for o in range(L.ORDER)], "t")
    some = np.concatenate([every["aa"][::97], every["l7"], np.arange(1, 1 << 12, 7)])
    assert np.allclose(model.losses(some), whole.losses(some), rtol=1e-6)


def test_values_of_many_languages_are_computed_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"] * 2), pa.array(["abc abd", "bca dab"])], names=["l", "t"])
    out = pa.Table.from_batches(L._count(iter([batch])))
    order = np.argsort(out.column(1).to_numpy())
    levels = L.kneser_ney(out.column(1).to_numpy()[order], out.column(2).to_numpy()[order])
    model = L.Model(["aa"], [L._merged([x[:2]], 0.0) for x in levels], [L._merged([x[2:]], 1.0) for x in levels], "t")
    words = ["abc", "", "dab", "123", "zzz", "bcabca"]
    at_once = model.compute(words)
    model.room = lambda values: 3
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(at_once, model.compute(words), strict=True))


def test_language_of_unseen_texts(spark):
    docs = corpus(spark)
    held = F.col("doc_id") % 4 == 0
    model = L.trained(docs, ~held)
    got = L.predict(docs.where(held), model, [F.col("lang")], F.col("text")).collect()
    assert all(r["lang"] == r["lang_pred"] and not r["rejected"] and 0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, "qqq jjj qjq hhh ooo ppp " * 40)], "doc_id bigint, text string")
    assert L.predict(odd, model, [F.col("doc_id")], F.col("text")).first()["rejected"]


def test_limits_come_from_every_training_text_whole(spark):
    rng = random.Random(7)
    texts = [sentence(rng, "aa", 8) for _ in range(1500)]
    texts[700] = " ".join("".join(rng.choice("abcdevwxyz") for _ in range(6)) for _ in range(4000))  # above 20,000 characters
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = L.trained(docs, F.lit(True))
    entropy = sorted(r["entropy"] for r in L.predict(docs, model, [F.col("doc_id")], F.col("text")).collect())
    assert len(entropy) == 1500
    assert abs(model.limits[0] - (2 * entropy[-1] - entropy[749])) < 1e-9


def test_languages_of_awkward_rows(spark):
    model = L.trained(corpus(spark, 20), F.lit(True))
    got = L.predict(table(spark), model, [F.col("doc_id"), F.struct("score", "_row").alias("carried")], F.col("text")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        wordless = r["doc_id"] in (4, 5, 6, 7, 12)
        assert (r["lang_pred"] == "und") == (wordless or r["letters"] == 0)
        assert math.isfinite(r["score"]) and math.isfinite(r["entropy"])
    assert L.predict(empty(spark), model, [F.col("doc_id")], F.col("text")).count() == 0
    none = L.trained(table(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    rows = L.predict(table(spark), none, [F.col("doc_id")], F.col("text")).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and not all(r["rejected"] for r in rows)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in T.initial(rng).items()}
    evidence, first = rng.normal(size=(6, 4, T.EVIDENCE)), rng.integers(0, 40, (6, 4))
    mask, target = np.arange(6)[:, None] < np.array([6, 4, 2, 6]), np.array([1.0, 0, 1, 0])
    _, grads = T.gradients(w, evidence, first, mask, target)
    for name, value in w.items():
        place = (first[0, 0], 1) if name == "E" else tuple(rng.integers(0, n) for n in value.shape)
        ends = []
        for step in (1e-5, -1e-5):
            value[place] += step
            ends.append(T.gradients(w, evidence, first, mask, target)[0])
            value[place] -= step
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][place]) < 1e-6, name


def toxic_corpus(n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 300))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vuzzak", "vuzzakel", "vuzzaking", "quorpix"])
        rows.append((" ".join(words), int(bad)))
    return rows


def test_windows_overlap_and_reach_the_end():
    starts, of = T.window_starts(np.array([0, 5, 32, 33, 100]))
    assert of.tolist() == [1, 2, 3, 3, 4, 4, 4, 4, 4, 4]
    assert starts.tolist() == [0, 5, 37, 38, 70, 86, 102, 118, 134, 138]


def test_toxic_words_are_found_in_unseen_texts():
    rows = toxic_corpus()
    train, test = rows[:180], rows[180:]
    net = T.train([t for t, _ in train], np.array([y for _, y in train]))
    held = T.Vocabulary(net.compute)

    def scores(texts):
        numbers, sizes = held.numbers(texts)
        return net.scores(T.text_logits(net, held.values[0], numbers, sizes), T.window_counts(sizes))

    got = scores([t for t, _ in test])
    assert np.mean((got >= 0.5) == np.array([y for _, y in test])) >= 0.95
    clean = next(t for t, y in test if not y)
    late = " ".join([clean] * 80) + " vuzzak quorpix vuzzakel"  # at the very end of a long text
    assert scores([late])[0] >= 0.5 > scores([" ".join([clean] * 80)])[0]


def test_toxicity_of_awkward_rows(spark):
    rows = toxic_corpus(90)
    docs = table(spark, [*[(1000 + i, t) for i, (t, _) in enumerate(rows)], *TEXTS])
    labels = spark.createDataFrame([(1000 + i, 0, y) for i, (_, y) in enumerate(rows)] + [(None, 0, 1), (1, 0, None)],
                                   "doc_id bigint, quality int, toxic int")
    net = T.fitted(docs, labels, F.lit(True))
    got = T.score(docs, net, [F.col("doc_id")], F.col("text")).collect()
    assert len(got) == len(rows) + len(TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6, 7))
    assert T.fitted(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in T.score(table(spark), None, [F.col("doc_id")], F.col("text")).collect()} == {0.0}
    assert T.score(empty(spark), net, [F.col("doc_id")], F.col("text")).count() == 0
