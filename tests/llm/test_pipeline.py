"""The corpus pipeline, stage by stage, against brute force on what the stage before kept."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import EDGES, rows, table
from test_rows import brute_poisson
from test_search import brute_components, brute_lines

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, the input first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [rows(docs)]
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, FOLDER), name.replace(" ", "_"))
        out.append(rows(docs))
    return out


def by_id(found):
    return {x["doc_id"]: x for x in found}


def test_columns(stages):
    for found in stages[:-1]:
        assert set(found[0]) == set(pipeline.COLUMNS)


def test_toxic_documents_go(spark, stages):
    """The rows that stay are those that the operator scores under one half, unchanged."""
    from lodestar.llm import queries, toxicity

    scored = toxicity.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), queries.toxicity_model(spark, FOLDER))
    clean = {x["doc_id"] for x in rows(scored) if x["score"] < 0.5}
    assert by_id(stages[1]) == {d: x for d, x in by_id(stages[0]).items() if d in clean} and len(stages[1]) == len(clean)
    labels = {x["doc_id"]: x["toxic"] for x in rows(spark.read.parquet(f"{FOLDER}/labels.parquet"))}
    assert sum(d in clean for d, t in labels.items() if not t) >= 0.97 * sum(not t for t in labels.values())


def test_lines_go(stages):
    docs = sorted((x["doc_id"], x["text"]) for x in stages[1])
    gone = brute_lines(docs, 50)
    expected = {}
    for k, (d, t) in enumerate(docs):
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ()))
        if k not in gone or text.strip():
            expected[d] = (text, len(text))
    assert {x["doc_id"]: (x["text"], x["n_chars"]) for x in stages[2]} == expected


def test_one_of_each_group_stays(stages):
    least = {d: c for d, _, c in brute_components([(x["doc_id"], x["text"]) for x in stages[2]])}
    assert sorted(x["doc_id"] for x in stages[3]) == sorted(d for d, c in least.items() if d == c)


def test_sources_are_mixed(stages):
    sizes = {}
    for x in stages[3]:
        sizes[x["source"]] = sizes.get(x["source"], 0) + 1
    root = sum(map(math.sqrt, sizes.values()))
    copies = {}
    for x in stages[4]:
        copies[x["doc_id"]] = copies.get(x["doc_id"], 0) + 1
    for x in stages[3]:
        n = sizes[x["source"]]
        u = (int(hashlib.md5(f"mix:{x['doc_id']}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert copies.get(x["doc_id"], 0) == brute_poisson(len(stages[3]) * math.sqrt(n) / root / n, u)


def test_ids(stages):
    import public_tokenizers
    import tiktoken

    from lodestar.llm import bpe

    ranks = {p: k for k, p in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text_of = {x["doc_id"]: x["text"] for x in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for x in stages[5]:
        assert np.frombuffer(x["ids"], "<u4").tolist() == reference.encode_ordinary(text_of[x["doc_id"]])
        assert x["decoded_sha256"] == hashlib.sha256(text_of[x["doc_id"]].encode()).hexdigest() and x["n_tokens"] == len(x["ids"]) // 4


def edge_rows(spark):
    return table(spark, EDGES).select(*pipeline.COLUMNS)


def keys(found):
    return sorted((str(x["doc_id"]), x["text"]) for x in found if x["text"] is not None) + [str(x["doc_id"]) for x in found if x["text"] is None]


def test_edge_rows_stage_by_stage(spark):
    toxic = rows(pipeline.drop_toxic(spark, edge_rows(spark), FOLDER))
    assert keys(toxic) == keys(rows(edge_rows(spark)))
    cut = rows(pipeline.drop_repeated_lines(spark, edge_rows(spark), FOLDER))
    assert sorted(str(x["doc_id"]) for x in cut) == sorted(str(d) for d, _ in EDGES if d != 6)  # 6 repeats 5
    near = rows(pipeline.drop_near_duplicates(spark, edge_rows(spark), FOLDER))
    # one of the two rows of 4 stays, 6 is a copy of 5, and 9 has the words of 8
    assert sorted(str(x["doc_id"]) for x in near) == sorted(str(d) for d in [1, 2, 3, 4, 5, None, None, 7, 8])
    ids = rows(pipeline.encode(spark, edge_rows(spark), FOLDER))
    assert sorted((str(x["doc_id"]), x["decoded_sha256"]) for x in ids) == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in EDGES)
    mixed = rows(pipeline.mix_sources(spark, edge_rows(spark), FOLDER))
    counts = lambda d: brute_poisson(1.0, (int(hashlib.md5(f"mix:{'null' if d is None else d}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    assert sorted(str(x["doc_id"]) for x in mixed) == sorted(str(d) for d, _ in EDGES for _ in range(counts(d)))


def test_near_duplicates_row_by_row(spark):
    a, u, b = (" ".join(f"{w}{k}" for k in range(30)) for w in "aub")
    docs = table(spark, [(1, a), (2, a), (2, u), (3, b), (3, b, "fr", "t"), (None, a), (None, u + " more"), (4, ""), (4, "")]).select(*pipeline.COLUMNS)
    found = rows(pipeline.drop_near_duplicates(spark, docs, FOLDER))
    assert sorted((x["doc_id"], x["text"], x["lang"]) for x in found) == sorted([(1, a, "en"), (2, u, "en"), (3, b, "en"), (4, "", "en"), (4, "", "en")])


def test_clashing_names_and_empty_tables(spark):
    extra = edge_rows(spark).withColumns({n: F.lit(n) for n in ("_score", "_toxic", "_deleted", "_key", "_source", "row", "ids", "component_id")})
    for _, stage in pipeline.STAGES:
        assert set(stage(spark, extra, FOLDER).columns) >= {"doc_id"}
        assert stage(spark, edge_rows(spark).limit(0), FOLDER).count() == 0
