"""Rows that every operator must bear: nulls, empty and long texts, repeats, columns of clashing names."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "node string, key string, band int, first string, places string, score string, row string, size string"
)
LONG = " ".join(f"word{i % 997} filler{i % 13}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old grey oak tree at dusk"
TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "b"),
    (3, BASE.upper(), "en", None),
    (4, "", "en", "a"),
    (5, None, None, None),
    (6, "one two", "en", "a"),
    (6, "one two", "en", "a"),
    (7, "ONE \t two\n", "de", "c"),
    (8, LONG, "de", "c"),
    (9, LONG + " tail", "de", "c"),
    (None, BASE, "en", "a"),
    (None, None, None, None),
    (10, "\n\n  \n", None, "a"),
    (11, "日本語 テキスト é ß İ <|endoftext|> \u0000 x", "ja", "b"),
]


def documents(spark, texts=TEXTS):
    rows = [(d, t, lang, s, None if t is None else len(t), "n", "k", 1, "f", "p", "s", "r", "z") for d, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
