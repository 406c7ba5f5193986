"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, items string, score string, copy string, shard string, row string, key string, rank string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(seed: int, n: int, line: int = 12) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[k : k + line]) for k in range(0, n, line))


def table(spark, rows):
    """rows: (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1]), *["x"] * 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


LONG = prose(99, 40_000)
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, LONG), (6, LONG), (None, "lost key and some more words"), (None, None), (7, "é ﷺ 漢字 \U0001f600 zero\x00byte"), (8, "a b c d e"), (9, "A B\tC D\x0bE")]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
