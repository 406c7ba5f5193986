import math
import re
from collections import Counter

import numpy as np
from cases import EDGES, LONG, SCHEMA, prose, table
from pyspark.sql import functions as F

from lodestar.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(rows, asked, k=10):
    counts = [Counter(terms(t)) for _, t in rows]
    n, total = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in asked:
        scored = []
        for (key, _), c in zip(rows, counts, strict=True):
            m = 25 + (75 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


ASKED = [(1, "word a b C d"), (2, "Lost KEY é 漢字"), (3, None), (4, ""), (5, "nothing-of-this zzzz"), (6, prose(99, 60)), (7, "word word word"), (None, "byte zero")]


def queries_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edge_rows(spark):
    rows = EDGES + [(20, "word"), (21, "word word"), (19, "Word"), (18, "WORD\xa0x")]
    assert found(search.ranked(search.index(table(spark, rows)), queries_of(spark, ASKED))) == expected(rows, ASKED)


def test_ties_across_shards_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    rows = [(k, "tie word" if k % 3 else f"tie other {k}") for k in range(300)] + [(None, "tie word"), (5, "tie word")]
    asked = [(1, "tie"), (2, "word tie"), (3, "other")]
    df = table(spark, rows).orderBy(F.rand(3)).repartition(5)
    assert found(search.ranked(search.index(df), queries_of(spark, asked), k=25)) == expected(rows, asked, 25)


def test_queries_in_blocks(spark):
    rows = [(k, prose(k, 30)) for k in range(40)]
    asked = [(k, prose(k % 40, 8)) for k in range(60)]
    blocks = search.query_blocks(queries_of(spark, asked), "item_id", "text", most=2000)
    ids = [r.id for b in blocks for r in b.collect()]
    assert len(blocks) > 3 and sorted(ids) == list(range(60))
    monkey = search.query_blocks
    search.query_blocks = lambda *a: blocks
    try:
        assert found(search.ranked(search.index(table(spark, rows)), queries_of(spark, asked))) == expected(rows, asked)
    finally:
        search.query_blocks = monkey


def test_one_key_with_two_texts_and_repeated_queries(spark):
    rows = [(1, "alpha beta"), (2, "beta gamma")]
    asked = [(1, "alpha"), (1, "alpha"), (1, "gamma")]
    assert found(search.ranked(search.index(table(spark, rows)), queries_of(spark, asked))) == expected(rows, [(1, "alpha"), (1, "gamma")])


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = queries_of(spark, ASKED)
    assert search.ranked(search.index(empty), some).collect() == []
    assert search.ranked(search.index(table(spark, EDGES)), some.limit(0)).collect() == []
    named = table(spark, EDGES).selectExpr("cast(doc_id AS string) AS item_id", "text AS terms", "'x' AS query", "'y' AS key")
    got = search.ranked(search.index(named, "item_id", "terms"), queries_of(spark, [(1, "word")]))
    assert got.columns == ["item_id", "rank", "item_id_found", "score"] and [r.item_id_found for r in got.collect()] == ["4", "4"]


def test_bytes_that_arent_utf8_belong_to_terms(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'6162ff' AS string) AS text UNION ALL SELECT 2, 'ab'")
    assert [r.doc_id for r in search.ranked(search.index(df), queries_of(spark, [(1, "ab")])).collect()] == [2]


def test_selection_keeps_ties():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        scores = r.integers(0, 6, n)
        for k in (1, 3, 10):
            limit = sorted(scores[scores > 0])[-k:]
            want = [i for i in range(n) if scores[i] > 0 and scores[i] >= (limit[0] if limit else 1)]
            assert search.best_places(scores, k).tolist() == want


def test_shards_are_rows_of_sorted_terms():
    words, starts, places, impacts = search.matrix([b"b a b", None, "É a".encode()], 2, 5)
    assert words == [b"a", b"b", "É".encode()] and starts.tolist() == [0, 2, 3, 4] and places.tolist() == [0, 2, 0, 2]
    m = [25 + 75 * n * 2 // 5 for n in (3, 0, 2)]
    assert impacts.tolist() == [10**9 // (1000 + 8 * m[0]), 10**9 // (1000 + 8 * m[2]), 2 * 10**9 // (2000 + 8 * m[0]), 10**9 // (1000 + 8 * m[2])]


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(queries.op12_search(spark, folder)) == expected(docs, items)
    assert len(LONG) > 1000
