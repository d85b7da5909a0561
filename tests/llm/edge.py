"""Small tables with the cases that every operator must bear."""

import re

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 4001}" for i in range(60_000))

# id, text: nulls, empty, blank, very long, copies, ties, a repeated row, other scripts, short
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, LONG),
    (5, "the QUICK brown fox jumps over the lazy dog and runs far away from here today"),
    (6, "The quick brown  fox jumps over the lazy dog and runs far away from here today"),
    (7, "one"),
    (8, "one"),
    (8, "one"),
    (9, "ünïcode ☃ text ▁ with\x0bodd\x0cspaces <|endoftext|> 漢字 ok"),
    (None, "a row without an id"),
    (10, "x" * 5000),
    (11, "one two"),
    (-3, "two one"),
]


def table(spark, rows=ROWS, name="text"):
    """Ids and texts among columns whose names could clash with an operator's own."""
    wide = [(i, t, "a", 1, 2.5, None, "b", 7, 8) for i, t in rows]
    schema = f"doc_id long, {name} string, id string, size int, score double, count string, digest string, length int, n int"
    return spark.createDataFrame(wide, schema)


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(ASCII_LOWER) if lower else text)
