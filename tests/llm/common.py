"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, shard string, root string, hub string, key string, "
    "held_out string, lang_pred string, prefix string, words string, removed_lines string, d1 string, member string, kept string, row string"
)
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(10_000))
TEXTS = [
    (1, "The cat sat on the mat, and the dog lay by the door of the old house."),
    (2, "The cat sat on the mat, and the dog lay by the door of the old house."),
    (2, "The cat sat on the mat, and the dog lay by the door of the old house."),
    (3, "the CAT sat on the mat, and the dog lay by the door of the old house."),
    (4, ""),
    (5, None),
    (None, "A text without an id.\n\nIt has two lines."),
    (None, None),
    (6, " \t\n\x0b\x0c\r "),
    (7, "é ñ 中文 😀   x"),
    (8, LONG),
    (9, LONG),
    (10, "tie tie tie tie"),
    (-11, "12345 !!! ###"),
    (12, "a\x00b\x1c c"),
]


def edge_docs(spark, texts=TEXTS):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rows = [(i, t, None if i in (3, 7) else "en" if (i or 0) % 2 else "de", None, None, *["x" if n != "score" else 0.5 for n in names[5:]]) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(text, lower=True):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in word) for word in found] if lower else found
