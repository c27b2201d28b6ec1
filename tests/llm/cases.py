"""Awkward tables that every operator must take."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

#: doc_id, text and columns whose names clash with names that operators use inside.
KIND = "doc_id long, text string, lang string, source string, n_chars long, name string, kept boolean, score double, n long, key string, label int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "x", None, 0.5, 1, None, 3, 9) for i, t in rows], KIND)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (5, None), (3, ""), (4, " \t\n "), (1, "one"), (2, "one two"), (7, "Ünï çødé 😀 ▁x  y\x00z\r\n"), (6, "one"),
    (8, LONG), (9, LONG + " end"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (12, "A B c d e f g h i j k l m n o p q r s t u v w x y z"),
]
MESSY = [(None, "same text here again"), (None, "same text here again"), (1, "same text here again"), (1, "same text here again"), (1, "other words"), (2, None), (2, None)]
