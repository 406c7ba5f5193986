"""Ranked lexical search: an index in shards of documents, with integer impacts, and exact top k for each query.

A shard is a row: some documents of a partition in the order of their keys, and a sparse matrix in compressed rows, one for each term (in byte order) with the
places of the documents that hold it and their impacts. An impact is what a document's length and a term's repetitions in it make of a term's weight; it needs
the corpus's number of documents and mean length, which one pass of counting finds before the index is written. Weights follow from how many documents hold a
query's terms, which the shards' row lengths tell.

Queries come in blocks of a bounded size. A block is sent to all tasks; a task walks over its shards, adds for each query the impacts of its terms, one term at a
time, into a dense array with a place for each document, selects its best documents with all ties, and keeps the best k of its shards. Only these meet in Spark.
A term that all documents hold is a row as long as its shard has documents, so no key is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import sliced, stored

# Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; a score is integer arithmetic with these numbers.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT, UNIT, SLOPE, SHARE = 1000, 1_000_000_000, 8, 75

#: Bytes of text and documents of a shard.
SHARD_BYTES, SHARD_ROWS = 2 << 20, 10_000
#: Bytes of query terms that are sent to the tasks at a time.
BLOCK_BYTES = 4 << 20


def _terms():
    """A function from bytes to the terms in them: separators become spaces, A to Z lower case. All bytes of characters beyond ASCII belong to terms."""
    table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
    return lambda data: data.translate(table).split()


@dataclass(frozen=True)
class Index:
    """Stored shards, and what impacts depend on: how many documents have a term, and how many terms there are."""

    shards: DataFrame
    key: str
    documents: int
    terms: int


def matrix(texts: list[bytes | None], documents: int, terms: int):
    """(vocabulary in byte order, starts, places, impacts) of a shard's texts."""
    import numpy as np
    import pyarrow as pa

    cut = _terms()
    found = [cut(t) if t else [] for t in texts]
    sizes = [len(f) for f in found]
    flat = pa.array([w for f in found for w in f], pa.binary()).dictionary_encode()
    words = flat.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    code = rank[flat.indices.to_numpy()] if words else np.zeros(0, np.int64)
    cells, tf = np.unique(code * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    term, place = np.divmod(cells, max(1, len(texts)))
    # whole numbers of any size: a length times the number of documents may pass 64 bits
    length = np.array([100 - SHARE + SHARE * n * documents // max(1, terms) for n in sizes], np.int64)
    impact = UNIT * tf.astype(np.int64) // (1000 * tf + SLOPE * length[place])
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
    return [words[k] for k in order], starts.astype("<u4"), place.astype("<u4"), impact.astype("<u4")


def index(df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows. Null, empty and term-less texts are in it, but found by nothing. Rows of equal key are indexed each for itself; other columns are left out."""
    slim = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    words = F.regexp_count(F.col(text), F.lit(TERM)).cast("long")
    counted = df.select(words.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = counted.documents, counted.terms
    schema = T.StructType([T.StructField("key", T.ArrayType(df.schema[key].dataType)), T.StructField("term", T.ArrayType(T.BinaryType())), *[T.StructField(n, T.BinaryType()) for n in ("starts", "places", "impacts")]])

    def shards(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
            for start, stop in sliced(sizes, SHARD_BYTES, SHARD_ROWS):
                some = pa.Table.from_batches([batch.slice(start, stop - start)]).sort_by([("key", "ascending")])  # nulls come last
                vocabulary, *arrays = matrix(some.column("text").to_pylist(), documents, terms)
                ids = some.column("key").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (ids, pa.array(vocabulary, pa.binary()))]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=schema.names)

    return Index(stored(slim.mapInArrow(shards, schema), "search-index", large_rows=True), key, documents, terms)


def query_blocks(queries: DataFrame, query_key: str, text: str, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct queries as (id, terms) in as many parts as it takes for none to hold more than `most` bytes of terms, unless one query alone does."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = queries.select(F.col(query_key).alias("id"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms")).where("size(terms) > 0").distinct()
    sized = asked.select("*", F.xxhash64("id", "terms").alias("hash"), F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + 64 + F.octet_length(t)).alias("bytes"))
    whole = stored(sized, "search-queries")
    total = whole.agg(F.sum("bytes")).first()[0] or 0  # one number
    parts = 1 + total // most
    while True:
        part = F.pmod("hash", F.lit(parts))
        heavy = whole.groupBy(part.alias("part")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > most) & (F.col("n") > 1))
        if parts == 1 and total <= most or not heavy.take(1):
            return [whole.where(part == k).select("id", "terms") for k in range(parts)]
        parts *= 2


def _document_counts(shards: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """In how many documents each term is: the lengths of its rows in all shards, which is all that is read of them."""
    sent = shards.sparkSession.sparkContext.broadcast(sorted(wanted))

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, total = pa.array(sent.value, pa.binary()), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for vocabulary, starts in zip(batch.column(0), batch.column(1), strict=True):
                at = pc.index_in(terms, vocabulary.values.cast(pa.binary()))
                rows = np.diff(np.frombuffer(starts.as_py(), "<u4").astype(np.int64))
                there = at.is_valid().to_numpy(zero_copy_only=False)
                total[there] += rows[at.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(total[some])], names=["term", "n"])

    counts = shards.select("term", "starts").mapInArrow(counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counts.collect()}  # as many rows as the block has terms at most


def best_places(scores, k: int):
    """The places of the k highest scores above 0, and of all that tie with the lowest of them."""
    import numpy as np

    if len(scores) > k:
        limit = max(1, int(np.partition(scores, len(scores) - k)[-k]))
        return np.flatnonzero(scores >= limit)
    return np.flatnonzero(scores > 0)


def _block_candidates(found: Index, block: DataFrame, number: int, k: int) -> DataFrame:
    """(query, key, score): each task's best k documents for each query of a block."""
    queries = [(r.id, [t.encode() for t in r.terms]) for r in block.collect()]  # a block has a bounded size
    held = _document_counts(found.shards, list({t for _, terms in queries for t in terms}))
    weight = {t: math.floor(WEIGHT * math.log((2 * found.documents + 2) / (2 * n + 1))) for t, n in held.items()}
    vocabulary = sorted(t for t, w in weight.items() if w > 0)
    at = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for _, terms in queries:
        times: dict[int, int] = {}
        for t in terms:
            if t in at:
                times[at[t]] = times.get(at[t], 0) + weight[t]
        asked.append(sorted(times.items()))
    spark = found.shards.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, asked))
    kind = found.shards.schema["key"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("key", kind), T.StructField("score", T.LongType())])

    def searched(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, questions = pa.array(sent.value[0], pa.binary()), sent.value[1]
        best: list[list] = [[] for _ in questions]  # (-score, key is null, key), at most k of each query
        for batch in batches:
            for ids, words, starts, places, impacts in zip(*batch.columns, strict=True):
                row = pc.fill_null(pc.index_in(terms, words.values.cast(pa.binary())), -1).to_pylist()
                starts, places, impacts = (np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in (starts, places, impacts))
                scores = np.zeros(len(ids.values), np.int64)
                for q, asked_terms in enumerate(questions):
                    rows = [(row[t], w) for t, w in asked_terms if row[t] >= 0]
                    if not rows:
                        continue
                    scores[:] = 0
                    for r, w in rows:
                        scores[places[starts[r] : starts[r + 1]]] += w * impacts[starts[r] : starts[r + 1]]
                    chosen = best_places(scores, k)
                    if len(best[q]) == k:
                        chosen = chosen[scores[chosen] >= -best[q][-1][0]]
                    if len(chosen):
                        # places follow the keys' order, so of a tie the first ones are enough
                        chosen = chosen[np.lexsort((chosen, -scores[chosen]))][:k]
                        keys = ids.values.take(pa.array(chosen)).to_pylist()
                        best[q] = sorted(best[q] + [(-s, i is None, 0 if i is None else i) for s, i in zip(scores[chosen].tolist(), keys, strict=True)])[:k]
        flat = [(q, None if none else i, -s) for q, rows in enumerate(best) for s, none, i in rows]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], batch_kind), pa.array([f[2] for f in flat], pa.int64())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(kind)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(queries)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", block.schema["id"].dataType)]))
    return found.shards.mapInArrow(searched, schema).join(F.broadcast(names), "query").select(F.struct(F.lit(number).alias("block"), "query").alias("query"), "id", "key", "score")


def ranked(found: Index, queries: DataFrame, query_key: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(query key, rank, key, score): the k documents of highest score for each query, ranked from 1; fewer where fewer have a score above 0.

    Equal scores rank by the key, null last. Null, empty and term-less queries find nothing. Queries equal in key and text are one; one key with different texts is as
    many queries, each with ranks of its own. Other columns are left out. The scores are whole numbers, exact at any size.
    """
    key = found.key if found.key != query_key else f"{found.key}_found"
    blocks = [_block_candidates(found, block, number, k) for number, block in enumerate(query_blocks(queries, query_key, text))]
    merged = blocks[0]
    for other in blocks[1:]:
        merged = merged.unionByName(other)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    top = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("id").alias(query_key), "rank", F.col("key").alias(key), "score")
