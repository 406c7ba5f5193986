"""How the tokens of two tokenizers lie over each other, and which pairs of them are each other's usual counterparts.

Tokenizer A is a byte-level BPE, tokenizer B a sentencepiece BPE with byte fallback. Both split the same bytes: a space and the text. Byte offsets where a token
of A and one of B end cut the tokens into groups; tokens of a group are linked.

A text is taken apart into chunks, a run of white space and what follows it; neither tokenizer has a token across the end of a chunk, which the vocabularies are
checked for, so chunks are encoded and aligned alone, each distinct one once. In each block of texts, DuckDB holds the new chunks' tokens as tables of byte
intervals: an as-of join finds for each token of A the last end of B at or before its own, a window sum over the ends that fall together numbers the groups, and
an as-of join with a range condition lays the tokens of B into the groups' intervals. A block gives how many of its documents hold each pair of ids; Spark adds these counts up and
finds each id's most frequent partner, and hands every block the totals of its own pairs, from which the block sums those of its documents.

Only the pairs' ids and counts of blocks are shuffled, neither texts nor tokens. A pair of nearly all blocks is one of at most 1,000, which are broadcast; the
others are joined by a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_characters
from .shared import columns, sliced, stored

#: A pair is id of A times PAIR plus id of B.
PAIR = 1 << 16
#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Bytes of text of a block.
BLOCK_BYTES = 2 << 20
#: Below this character, Unicode's letters and digits have been settled for long, so that the two libraries for A agree on them.
SETTLED = "\u0530"

#: White space and what follows it; ends where a character that isn't white space meets a space or a line end.
CHUNK = r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+\Z"

GROUPS = """
CREATE OR REPLACE TEMP TABLE in_a AS
WITH met AS (SELECT a.*, coalesce(b.stop = a.stop, false) AS closes FROM a ASOF LEFT JOIN b ON a.stop >= b.stop)
SELECT pos, chunk, id, start, stop, coalesce(sum(closes::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp FROM met;
CREATE OR REPLACE TEMP TABLE spans AS SELECT grp, min(start) AS start, max(stop) AS stop FROM in_a GROUP BY grp;
CREATE OR REPLACE TEMP TABLE in_b AS SELECT b.pos, b.id, spans.grp FROM b ASOF JOIN spans ON b.start >= spans.start WHERE b.start < spans.stop;
"""
#: Groups whose tokens of both sides make more links than so many are counted by their distinct ids.
LARGE_GROUP = 10_000
LINKS = "SELECT x.chunk, x.id * 65536 + y.id AS pair, count(*) AS times FROM in_a x JOIN in_b y USING (grp) WHERE grp NOT IN (SELECT grp FROM large) GROUP BY ALL"
LARGE = """
SELECT x.chunk, x.id * 65536 + y.id AS pair, sum(x.n * y.n)::BIGINT AS times
FROM (SELECT chunk, grp, id, count(*) AS n FROM in_a SEMI JOIN large USING (grp) GROUP BY ALL) x JOIN (SELECT grp, id, count(*) AS n FROM in_b SEMI JOIN large USING (grp) GROUP BY ALL) y USING (grp) GROUP BY ALL
"""
HELD = "SELECT pair, count(*) AS n FROM (SELECT DISTINCT held.doc, links.pair FROM held JOIN links ON held.chunk = links.chunk) GROUP BY pair ORDER BY pair"


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each id of B: U+2581 is a space, <0xHH> a byte."""
    return [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in range(processor.vocab_size())]


class Vocabularies:
    """Both tokenizers, for chunks. `a` is a byte-level BPE in the tokenizers library's format, `b` a serialised sentencepiece model."""

    def __init__(self, a: str, b: bytes):
        import json
        import os

        import numpy as np
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(a)
        self.tokenizer.encode_special_tokens = True
        own = json.loads(a)["model"]
        back = {c: k for k, c in enumerate(byte_characters())}
        ranked = {bytes([back[c] for c in piece]): i for piece, i in own["vocab"].items() if all(c in back for c in piece)}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in own["merges"]]
        if [own["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("A's ids must follow its merges")
        ranked = {piece: i for piece, i in ranked.items() if i < 256 + len(merged)}
        self.settled = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranked, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(own["vocab"].values()) + 1)
        for piece, i in ranked.items():
            self.bytes_a[i] = piece

        model = pb.ModelProto.FromString(b)
        crossing = re.compile("[^\\s▁][▁\n]").search
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or any(crossing(p.piece) for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL):
            raise ValueError("B must leave texts as they are and have no piece in which a space or a line end follows another character")
        model.normalizer_spec.add_dummy_prefix = False  # a chunk brings its own space
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_b = piece_bytes(self.processor)
        most = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in most]  # ids with what follows them
        self.sizes = [np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b)]

    def encoded(self, chunks: list[str], at_once: int = 2000):
        """(ids of A, ids of B) of each chunk."""
        for k in range(0, len(chunks), at_once):
            some = chunks[k : k + at_once]
            settled = [c.isascii() or max(c) < SETTLED for c in some]
            others = iter(self.tokenizer.encode_batch_fast([c for c, s in zip(some, settled, strict=True) if not s], add_special_tokens=False))
            by_a = [self.settled(c) if s else next(others).ids for c, s in zip(some, settled, strict=True)]
            yield from zip(by_a, self.processor.encode(some, num_threads=1), strict=True)


class Aligner:
    """Aligned chunks, by number; an aligner forgets all when it remembers too many."""

    def __init__(self, vocabularies: Vocabularies):
        import duckdb

        self.vocabularies, self.database = vocabularies, duckdb.connect(config={"threads": 1})
        self.cut = re.compile(CHUNK).findall
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.shown: list[str] = []  # the groups of each chunk, as text
        self.whole = np.zeros(0, bool)  # whether both token sequences give the chunk's bytes
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, links
        self.first = np.zeros(1, np.int64)  # where each chunk's pairs begin
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def numbers(self, texts: list[str]):
        """The chunks' numbers of each text, after a space; new chunks are aligned."""
        known = self.known
        if len(known) > REMEMBERED:
            self.forget()
            known = self.known
        had = len(known)
        found = [[known.setdefault(c, len(known)) for c in self.cut(" " + t)] for t in texts]
        if len(known) > had:
            self.align(list(known)[had:])
        return found

    def align(self, chunks: list[str]) -> None:
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        voc = self.vocabularies
        both = [[], []]
        for ids in voc.encoded(chunks):
            for side, x in zip(both, ids, strict=True):
                side.append(x)
        whole = self._whole(chunks, both)
        if not whole.all():
            both = [[x if ok else [] for x, ok in zip(side, whole.tolist(), strict=True)] for side in both]
        tables, numbers = {}, []
        for name, side, size in zip("ab", both, voc.sizes, strict=True):
            n = np.fromiter(map(len, side), np.int64, len(side))
            ids = np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))
            stop = np.cumsum(size[ids])
            tables[name] = pa.table({"pos": np.arange(len(ids), dtype=np.int32), "chunk": np.repeat(np.arange(len(side), dtype=np.int32), n), "id": ids, "start": stop - size[ids], "stop": stop})
            numbers.append(n)
            self.database.register(name, tables[name])
        del both
        self.database.execute(GROUPS)
        groups = [self.database.sql(f"SELECT grp FROM in_{x} ORDER BY pos").fetchnumpy()["grp"] for x in "ab"]
        sizes = [np.bincount(g, minlength=1) for g in groups]
        large = np.flatnonzero(sizes[0] * sizes[1] > LARGE_GROUP)
        self.database.register("large", pa.table({"grp": large.astype(np.int32)}))
        links = self.database.sql(f"SELECT * FROM ({LINKS}{' UNION ALL ' + LARGE if len(large) else ''}) ORDER BY chunk, pair").fetchnumpy()
        for name in ("a", "b", "large"):
            self.database.unregister(name)
        self.shown += self._shown(tables, groups, len(chunks))
        # groups rise with the tokens, so a chunk has as many as its tokens of A begin
        begins = np.diff(groups[0], prepend=-1) > 0
        n_groups = np.bincount(tables["a"]["chunk"].to_numpy()[begins], minlength=len(chunks))
        n_links = np.bincount(links["chunk"], links["times"], len(chunks)).astype(np.int64)
        self.whole = np.concatenate([self.whole, whole])
        self.counts = np.concatenate([self.counts, np.stack([*numbers, n_groups, n_links], axis=1)])
        ends = np.cumsum(np.bincount(links["chunk"], minlength=len(chunks))) + len(self.pairs)
        self.first = np.concatenate([self.first, ends])
        self.pairs = np.concatenate([self.pairs, links["pair"]])
        self.times = np.concatenate([self.times, links["times"]])

    def _whole(self, chunks: list[str], both):
        """Whether both token sequences of a chunk give its bytes; chunk by chunk only if they don't give those of all."""
        import numpy as np

        tables = (self.vocabularies.bytes_a, self.vocabularies.bytes_b)
        joined = [[b"".join([table[i] for i in x]) for x in side] for table, side in zip(tables, both, strict=True)]
        data = [c.encode() for c in chunks]
        return np.array([a == b == d for a, b, d in zip(*joined, data, strict=True)], bool)

    def _shown(self, tables, groups, n: int) -> list[str]:
        """`a1,a2|b1;a3|b2` of each chunk."""
        import numpy as np

        a, b = groups
        total = int(a[-1]) + 1 if len(a) else 0
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=total)) for g in groups)
        places = np.arange(len(a)) + np.concatenate([[0], upto_b])[a], np.arange(len(b)) + upto_a[b]
        names = self.vocabularies.names
        tokens = np.empty(len(a) + len(b), np.int64)
        for side, (name, place, g) in enumerate(zip("ab", places, groups, strict=True)):
            last = np.diff(g, append=total) > 0  # the group's last on this side
            tokens[place] = tables[name]["id"].to_numpy() + last * (side + 1) * (len(names) // 3)
        texts = [names[i] for i in tokens.tolist()]
        sizes = sum(np.bincount(tables[name]["chunk"].to_numpy(), minlength=n) for name in "ab")
        stops = np.cumsum(sizes).tolist()
        return ["".join(texts[p:q])[:-1] for p, q in zip([0, *stops], stops, strict=False)]

    def block(self, texts: list[str | None]):
        """What a block of texts comes to: counts and digest of each, its chunks with their repetitions, the block's pairs with the number of texts that hold each, and the pairs of each chunk."""
        import hashlib

        import numpy as np
        import pyarrow as pa

        found = self.numbers([t or "" for t in texts])
        ok = [bool(t) and bool(self.whole[f].all()) for t, f in zip(texts, found, strict=True)]
        found = [f if good else [] for f, good in zip(found, ok, strict=True)]
        digests = [hashlib.sha256(";".join([self.shown[c] for c in f]).encode()).hexdigest() if f else "" for f in found]
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        chunk = np.array([c for f in found for c in f], np.int64)
        held, times = np.unique(doc * (len(self.known) + 1) + chunk, return_counts=True)
        doc, chunk = np.divmod(held, len(self.known) + 1)
        counts = np.stack([np.bincount(doc, times * self.counts[chunk, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        used, chunk = np.unique(chunk, return_inverse=True)
        n_pairs = self.first[used + 1] - self.first[used]
        own = np.repeat(self.first[used] - np.cumsum(n_pairs) + n_pairs, n_pairs) + np.arange(n_pairs.sum())
        pairs, place = np.unique(self.pairs[own], return_inverse=True)
        self.database.register("held", pa.table({"doc": doc, "chunk": chunk}))
        self.database.register("links_of_block", pa.table({"chunk": np.repeat(np.arange(len(used)), n_pairs), "pair": place}))
        documents = self.database.sql(HELD.replace("links", "links_of_block")).fetchnumpy()["n"]
        for name in ("held", "links_of_block"):
            self.database.unregister(name)
        packed = {"chunks": np.bincount(doc, minlength=len(texts)), "chunk": chunk, "repeated": times, "pairs_of": n_pairs, "pair_at": place, "times": self.times[own]}
        return counts, digests, pairs, documents, {k: v.astype("<u4").tobytes() for k, v in packed.items()}


PACKED = ("chunks", "chunk", "repeated", "pairs_of", "pair_at", "times")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _lists(values, n: int):
    """An Arrow list array of one list, of n values."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)


def blocks(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block of texts of a partition: keys, counts and digests, packed chunks, and (pair, texts) of the block's own pairs in rising order."""
    with open(a_path) as file:
        a = file.read()
    with open(b_path, "rb") as file:
        b = file.read()
    sent = df.sparkSession.sparkContext.broadcast((a, b))
    kind = df.schema[key].dataType
    numbers = [T.StructField(n, T.ArrayType(T.LongType())) for n in COUNTS]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("key", T.ArrayType(kind)), *numbers, T.StructField("digest", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.BinaryType()) for n in PACKED], T.StructField("pair", T.ArrayType(T.LongType())), T.StructField("documents", T.ArrayType(T.LongType())),
    ])

    def made(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        aligner, number = Aligner(Vocabularies(*sent.value)), TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, stop in sliced(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), BLOCK_BYTES, 10_000):
                some = batch.slice(start, stop - start)
                counts, digests, pairs, documents, packed = aligner.block(columns(some, "text")[0])
                row = {"block": pa.array([number], pa.int64()), "key": _lists(some.column(some.schema.get_field_index("key")), some.num_rows)}
                row |= {n: _lists(pa.array(counts[:, k]), some.num_rows) for k, n in enumerate(COUNTS)}
                row |= {"digest": _lists(pa.array(digests, pa.string()), some.num_rows)} | {n: pa.array([packed[n]], pa.binary()) for n in PACKED}
                row |= {"pair": _lists(pa.array(pairs, pa.int64()), len(pairs)), "documents": _lists(pa.array(documents, pa.int64()), len(pairs))}
                yield pa.RecordBatch.from_pydict(row)
                number += 1

    slim = df.select(F.col(key).alias("key"), F.try_validate_utf8(F.col(text)).alias("text"))
    return slim.mapInArrow(made, schema)


def pair_totals(made: DataFrame) -> DataFrame:
    """(pair, total, best, in_blocks) of all blocks' pairs: how many texts hold the pair, and whether no other pair of its A id is held by more."""
    pairs = made.select(F.explode(F.arrays_zip("pair", "documents")).alias("p")).select("p.*")
    totals = stored(pairs.groupBy("pair").agg(F.sum("documents").alias("total"), F.count("*").alias("in_blocks")), "align-totals")
    of = F.expr(f"pair div {PAIR}")
    highest = totals.groupBy(of.alias("of")).agg(F.max("total").alias("highest"))  # a row for each id of A's vocabulary at most
    return totals.join(F.broadcast(highest), of == F.col("of")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"), "in_blocks")


def aligned(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_links counts the linked pairs of token occurrences; count_sum sums over them how many rows of df hold the pair of ids linked; n_best counts those whose pair is
    held most of all pairs of the same A id, ties included. groups_sha256 is the digest of the groups' ids. Null and empty texts, texts that aren't UTF-8 and those
    whose token bytes differ from a space and the text (U+2581 is one such) have no tokens: zeros, and an empty text for the digest. Rows are counted one by one,
    also repeated ones and those without a key; columns besides key and text are left out. An empty table gives none.
    """
    made = stored(blocks(df, a_path, b_path, key, text), "align-blocks", large_rows=True)
    totals = stored(pair_totals(made), "align-pairs")
    rows = totals.agg(F.sum("in_blocks")).first()[0] or 0  # one number
    hot = totals.where(F.col("in_blocks") * 1000 > rows).select("pair", "total", "best")  # 1,000 rows at most
    own = made.select("block", F.explode("pair").alias("pair"))
    common = own.join(F.broadcast(hot), "pair")
    others = own.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(totals.select("pair", "total", "best"), "pair")
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in (*COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def summed(block, told):
        import numpy as np
        import pyarrow as pa

        row = {n: block.column(n)[0] for n in block.schema.names}
        chunks, chunk, repeated, pairs_of, pair_at, times = (np.frombuffer(row[n].as_py(), "<u4").astype(np.int64) for n in PACKED)
        place = np.argsort(told.column("pair").to_numpy())  # a block names its pairs by their places in rising order
        of, doc = np.repeat(np.arange(len(pairs_of)), pairs_of), np.repeat(np.arange(len(chunks)), chunks)

        def sums(name):
            weight = told.column(name).to_numpy().astype(np.int64)[place]
            by_chunk = np.zeros(len(pairs_of), np.int64)
            np.add.at(by_chunk, of, times * weight[pair_at])
            by_doc = np.zeros(len(chunks), np.int64)
            np.add.at(by_doc, doc, repeated * by_chunk[chunk])
            return pa.array(by_doc)

        return pa.Table.from_arrays([row["key"].values, *[row[n].values for n in COUNTS], sums("best"), sums("total"), row["digest"].values], names=out.names)

    # a block and its pairs at a time: a block has some MB, so neither a task's blocks nor lists of their pairs are ever held together
    told = common.unionByName(others).withColumnRenamed("block", "of")
    return made.drop("pair", "documents").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(summed, out)
