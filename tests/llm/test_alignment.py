import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from cases import EDGES, LONG, SCHEMA, prose, table

from lodestar.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> x", "a▁b", "▁", " \t tab\r\n\r\nnext  two   three\n\n", "nbsp\xa0here　there \x1c \x1d\x1e", "don't can't I'LL we've", "漢字かな交じり文。 第二", "한국어 문장 😀👩‍👩‍👧 end",
       "x" * 3000, " " * 900, "\n" * 50, "0" * 200 + " 1 22 333", "a \x00 b", "café ÀÉ ß naïve", "if (x) {\r\n\treturn;\r\n}\r\n", "हिन्दी में लिखा", "؟ مرحبا", "</s><s><unk> <0x41>"]


class Whole:
    """Both tokenizers over whole texts, and groups from the sets of their ends."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PATHS[1])
        self.b_bytes = alignment.piece_bytes(self.b)
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {**{chr(b): b for b in kept}, **{chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}}
        self.a_bytes = {i: bytes(letters[c] for c in p) for p, i in self.a.get_vocab().items() if all(c in letters for c in p)}

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        data = (" " + text).encode()
        if b"".join(self.a_bytes[i] for i in a) != data or b"".join(self.b_bytes[i] for i in b) != data:
            return []
        ends = []
        for ids, size in ((a, self.a_bytes), (b, self.b_bytes)):
            at, own = 0, []
            for i in ids:
                at += len(size[i])
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out, p, q = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while p < len(a) and ends[0][p] <= cut:
                left.append(a[p])
                p += 1
            while q < len(b) and ends[1][q] <= cut:
                right.append(b[q])
                q += 1
            out.append((left, right))
        return out


@pytest.fixture(scope="module")
def whole():
    return Whole()


def expected(whole, rows):
    """(key, text) rows to result rows, by listing all links."""
    grouped = [whole.groups(t) for _, t in rows]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in grouped]
    held = Counter(p for one in links for p in one)
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), g, one in zip(rows, grouped, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(one.values()), sum(n for p, n in one.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in one.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_edge_rows(spark, whole):
    rows = [r for r in EDGES if r[1] != LONG] + [(100 + k, t) for k, t in enumerate(ODD)] + [(5, LONG[:20_000]), (6, LONG[:20_000])]
    assert found(alignment.aligned(table(spark, rows), *PATHS)) == expected(whole, rows)


def test_texts_that_arent_utf8_have_no_tokens(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'6162ff' AS string) AS text")
    assert found(alignment.aligned(df, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_very_long_text_and_clashing_names(spark, whole):
    text = LONG + " " + "z" * 50_000
    rows = [(1, text), (2, "one two")]
    df = table(spark, rows).selectExpr("doc_id AS pair", "text AS block", "ids AS total", "items AS best")
    assert found(alignment.aligned(df, *PATHS, key="pair", text="block")) == expected(whole, rows)


def test_an_empty_table(spark):
    df = alignment.aligned(spark.createDataFrame([], SCHEMA), *PATHS)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and df.count() == 0


def test_random_strings_and_forgetting(whole, monkeypatch):
    """Chunks aligned alone give what whole texts give, also after the aligner has forgotten them."""
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    with open(PATHS[0]) as a, open(PATHS[1], "rb") as b:
        aligner = alignment.Aligner(alignment.Vocabularies(a.read(), b.read()))
    r = random.Random(7)
    alphabet = ["a", "the", "ing", "Z", "é", "漢", "😀", "9", "42", " ", " ", "  ", "\n", "\r", "\t", "\xa0", "　", "\x85", "\x1c", "'s", "'", ".", "!?", "-", "́", "क", "ि", " ", "_", "{", "}"]
    for turn in range(3):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
        counts, digests, pairs, documents, _ = aligner.block(texts)
        held = Counter()
        for k, t in enumerate(texts):
            g = whole.groups(t)
            shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            assert digests[k] == (hashlib.sha256(shown.encode()).hexdigest() if g else ""), t
            assert counts[k].tolist() == [sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(len(x) * len(y) for x, y in g)]
            held.update({x * alignment.PAIR + y for left, right in g for x in left for y in right})
        assert dict(zip(pairs.tolist(), documents.tolist(), strict=True)) == dict(held)


def test_a_hot_pair_is_broadcast_and_counts_whole(spark, whole, monkeypatch):
    """A text in a third of all rows, over many blocks."""
    rows = [(k, "same words here" if k % 3 == 0 else prose(k, 8)) for k in range(90)]
    df = table(spark, rows).repartition(12)
    assert found(alignment.aligned(df, *PATHS)) == expected(whole, rows)


def test_the_query(spark, whole):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_alignment(spark, folder)) == expected(whole, rows)


def test_blocks_are_stored_and_summed_one_at_a_time(spark, whole, monkeypatch):
    """A task with many blocks holds neither their rows nor lists of their pairs together."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
    rows = [(k, prose(k % 7, 8) if k % 5 else None) for k in range(60)]
    made = alignment.aligned(table(spark, rows).coalesce(1), *PATHS)
    assert found(made) == expected(whole, rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
