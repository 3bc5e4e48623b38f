"""Rows with nulls, empty and long texts, ties, repeated rows and clashing column names."""

LONG = " ".join(f"w{i % 997}" for i in range(20_000)) + "."
SAME = "the same line of ten words is here once again today."
MESSY = [
    (1, SAME),
    (2, None),
    (None, SAME),
    (3, SAME),
    (3, "another text under the same id of a document, with words."),
    (4, SAME),
    (4, SAME),
    (5, ""),
    (6, " \t\n "),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "ünïcödé — “quotes” 日本語 🙂 \x00 end."),
    (10, "x" * 70_000),
    (11, "a|b|c|d\nHOME | NEWS | ABOUT | CONTACT\n" + SAME),
    (None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def awkward(spark, rows=MESSY):
    """The rows beside columns named like the operators' own."""
    full = [(i, t, "en", "s", len(t or ""), 1, 2, 3, [4]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, part int, m int, _rows int, list array<int>").withColumnRenamed("m", "rest")
