"""A small table with every awkward row, and an empty one of the same columns."""

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, body string, "
          "score double, bucket int, node string, part int, _row string, shard string")
EXTRA = ("k", "b", 0.5, 1, "n", 2, "r", "s")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))

TEXTS = [
    (1, "the cat sat on the mat and then it ran off over the long hill"),
    (2, "the cat sat on the mat and then it ran off over the long hill"),
    (3, "the cat  sat on\tthe mat and then it ran off over the long hill"),
    (4, None), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, LONG), (10, LONG),
    (11, "été à l'école 日本語 ▁ ok\x1cz <|endoftext|>"), (12, "12345 67890 !!! ???"),
    (13, "x" * 20_000), (None, "no id here at all, none"), (None, None), (14, "again"), (14, "again"),
]


def table(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None, *EXTRA) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
