"""Line deduplication and the similarity join against brute force."""

import random
import re

import pytest
from cases import EDGES, prose, rows, table, words
from pyspark.sql import functions as F

from lodestar.llm import components, linededup, ngram

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(docs, min_words):
    """{place in docs: deleted line numbers}, for documents in order; tries every earlier start for every line."""
    seqs = [t.split("\n") for _, t in docs]
    gone = {}
    for a, own in enumerate(seqs):
        for i in range(len(own)):
            for b in range(a + 1):
                for j in range(len(seqs[b]) if b < a else i):
                    k = 0
                    while i + k < len(own) and j + k < len(seqs[b]) and own[i + k] == seqs[b][j + k]:
                        k += 1
                    if k and sum(len(WORD.findall(x)) for x in own[i : i + k]) >= min_words:
                        gone.setdefault(a, set()).update(range(i, i + k))
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_as_by_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(words(k, r.randint(0, 4))) for k in range(8)]
    docs = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for k in range(14)]
    gone = brute_lines(docs, 6)
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, (d, t) in enumerate(docs)}
    found = rows(linededup.dedup(table(spark, docs), min_words=6))
    assert {x["doc_id"]: x["text"] for x in found} == expected
    assert {x["doc_id"]: x["deleted_lines"] for x in found} == {d: len(gone.get(k, ())) for k, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("seed", [7, 8])
def test_intervals_are_those_of_a_suffix_array(spark, seed):
    """Runs named alike by two blocks are the members of one interval of the sorted suffixes with a common prefix of the run's length."""
    r = random.Random(seed)
    docs = [(k, "\n".join(r.choice(["a b", "c", "d e f", ""]) for _ in range(r.randint(3, 20)))) for k in range(10)]
    seqs = {d: t.split("\n") for d, t in docs}
    suffixes = sorted(((seqs[d][i:], d, i) for d in seqs for i in range(len(seqs[d]))), key=lambda x: x[0])

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    lcp = [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    frame = table(spark, docs).select(F.col("doc_id").alias("key"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    lines = linededup.stretches(linededup.repeated_lines(frame), 5)
    lines = linededup.stored(lines, "test-lines")
    runs = linededup.stored(linededup.shortest_runs(lines, 5), "test-runs")
    blocks, seen = linededup.reached(lines, runs), {}
    for level in range(5):
        blocks = linededup.doubled(blocks, 1 << level - 1) if level else blocks
        for x in rows(linededup.intervals(runs, blocks, 1 << level)):
            seen.setdefault((x["length"], x["head"], x["tail"]), set()).add((x["key"], x["start"]))
    groups = {}
    for x in rows(runs):
        m, at = x["length"], next(k for k, s in enumerate(suffixes) if s[1:] == (x["key"], x["start"]))
        low = at
        while low and lcp[low - 1] >= m:
            low -= 1
        groups.setdefault((m, low), set()).add((x["key"], x["start"]))
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == sorted(sorted(g) for g in seen.values() if len(g) > 1)
    assert sum(map(len, groups.values())) >= sum(map(len, seen.values()))


def test_lines_of_edge_rows(spark):
    found = rows(linededup.dedup(table(spark, EDGES)))
    assert len(found) == len(EDGES)
    by = {x["doc_id"]: x for x in found if x["doc_id"] is not None}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[5]["deleted_lines"] == 0 and by[6]["text"] == "" and by[4]["text"] == "word"
    assert rows(linededup.dedup(table(spark, EDGES[:1]).limit(0))) == []


def test_lines_stay_native(spark):
    plan = linededup.dedup(table(spark, EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(sets, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, len(s), least.get(x)) for (d, s), x in zip(sets, label, strict=True)), key=str)


def copies(r, base, n, changes):
    for _ in range(n):
        w = base.split(" ")
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = words(r.random(), 1)[0]
        yield " ".join(w)


@pytest.mark.parametrize("seed", [3, 4])
def test_components_as_by_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [prose(k, r.randint(1, 60), 60) for k in range(30)]
    for k in range(6):  # groups around a base, some members just out of reach of each other
        texts += copies(r, prose(100 + k, r.choice([20, 60, 150]), 200), 25, 8)
    texts += [texts[-1]] * 10 + ["common passage of seven words in all " + prose(900 + k, 3, 9) for k in range(40)]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    found = rows(ngram.near_duplicates(table(spark, docs)))
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found), key=str) == brute_components(docs)


def test_components_of_edge_rows(spark):
    found = rows(ngram.near_duplicates(table(spark, EDGES)))
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in found), key=str) == brute_components(EDGES)
    assert rows(ngram.near_duplicates(table(spark, EDGES).limit(0))) == []


def test_one_word_longer_than_a_chunk():
    tokens = ngram.Tokens()
    text = "a b " + "x" * (3 * ngram.CHUNK_BYTES) + " c d e"
    assert len(tokens.of(text)) == 2 and len(tokens.of(prose(1, 300_000))) == len(shingles(prose(1, 300_000)))


def test_graph_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 101)]
    found = {x["node"]: x["component"] for x in rows(components.components(spark.createDataFrame(edges, "a int, b int")))}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert rows(components.components(spark.createDataFrame([], "a int, b int"))) == []
    assert spark.range(1).select(F.lit(1)).count() == 1


def half_overlapping(n):
    """n near copies each of two texts that share half of their words."""
    r = random.Random(n)
    shared, own = prose(1, 120, 200), [prose(2, 120, 200), prose(3, 120, 200)]
    return [t for side in own for t in copies(r, f"{shared} {side}", n, 4)]


def compared_pairs(spark, monkeypatch, texts):
    """How many pairs of classes are compared on the way, and the components."""
    seen, plain = [0], ngram.compared

    def counting(pairs, sets):
        kept = ngram.stored(pairs.select("a", "b"), "counted")
        seen[0] += kept.count()
        return plain(kept, sets)

    monkeypatch.setattr(ngram, "compared", counting)
    found = rows(ngram.near_duplicates(table(spark, list(enumerate(texts)))))
    return seen[0], len({x["component_id"] for x in found})


def test_pairs_grow_with_the_copies(spark, monkeypatch):
    few, parts = compared_pairs(spark, monkeypatch, half_overlapping(150))
    many, again = compared_pairs(spark, monkeypatch, half_overlapping(300))
    assert parts == again == 2
    assert few <= 6 * 300 and many <= 6 * 600


def templated(n: int) -> list:
    """Documents of one template: 84.5 % of their words are common, which is a little too few for a link."""
    common = prose(1, 845)
    return [(k, common + "\n" + prose(1000 + k, 155)) for k in range(n)]


def joined_rows(spark, monkeypatch, rows) -> int:
    counted = []

    def counting(asking, heads, place, plain=ngram.fitting):
        counted.append(asking.join(heads, [*place, "order", "part"]).count())
        return plain(asking, heads, place)

    monkeypatch.setattr(ngram, "fitting", counting)
    found = ngram.near_duplicates(table(spark, rows)).groupBy("component_id").count()
    assert found.count() == len(rows)  # none is linked
    monkeypatch.undo()
    return sum(counted)


def test_templated_documents_make_no_pairs(spark, monkeypatch):
    few, more, many = (joined_rows(spark, monkeypatch, templated(n)) for n in (150, 300, 600))
    assert few <= 50 * 150 and more <= 50 * 300 and many <= 50 * 600


def made_sets(spark, tokens: dict, buckets: dict, share: dict):
    """Sets as `ngram.members` gives them, with chosen first buckets; no other bucket has two classes."""
    made = []
    for k, (name, own) in enumerate(tokens.items()):
        packed = ngram.np.unique(ngram.mixed(ngram.np.array(sorted(own), ngram.np.uint64)))
        made.append((bytearray(name.encode()), len(packed), share.get(name, 0.9), [buckets[name], *range(1000 * k + 1000, 1000 * k + 1015)], bytearray(packed.tobytes())))
    return spark.createDataFrame(made, ngram.MEMBER)


def test_two_references_may_be_linked_in_several_places(spark):
    x, z, both = set(range(100)), set(range(200, 300)), set(range(400, 460))
    tokens = {"r1": set(range(50)) | set(range(200, 250)) | both, "r2": x | both, "a1": x | both | set(range(500, 510)), "a2": z | set(range(410, 460)), "b2": z | both}
    sets = made_sets(spark, tokens, {"r1": 1, "a1": 1, "a2": 1, "r2": 2, "b2": 2}, {"r1": 1.0, "r2": 1.0})
    parts = {bytes(r["node"]).decode(): bytes(r["component"]).decode() for r in rows(components.components(ngram.links_of(sets)))}
    assert parts == {"a1": "a1", "r2": "a1", "a2": "a2", "b2": "a2"}


def test_members_of_a_cluster_are_tried_in_rounds(spark, monkeypatch):
    """n classes, each linked with a quarter of the n members of one cluster, but neither with its root nor with each other."""
    r, n, seen, plain = random.Random(5), 240, [0], ngram.compared
    base = list(range(400))
    tokens = {"root": set(base)}
    for k in range(n):
        quarter = {10_000 + 1000 * (k % 4) + j for j in range(40)}
        tokens[f"m{k}"] = set(base[40:]) | quarter | {50_000 + k}
        tokens[f"s{k}"] = set(base[40:]) - set(r.sample(base[40:], 40)) | quarter | {90_000 + 50 * k + j for j in range(40)}

    def counting(pairs, sets):
        kept = ngram.stored(pairs.select("a", "b"), "counted")
        seen[0] += kept.count()
        return plain(kept, sets)

    monkeypatch.setattr(ngram, "compared", counting)
    links = ngram.links_of(made_sets(spark, tokens, {t: 100_000 + k if t[0] == "s" else 1 for k, t in enumerate(tokens)}, {"root": 1.0}))
    parts = rows(components.components(links))
    assert len(parts) == len(tokens) and len({bytes(x["component"]) for x in parts}) == 1
    assert seen[0] <= 25 * n


def test_groups_linked_over_others_are_not_all_compared(spark, monkeypatch):
    """n classes, each linked with all others but only similar to the one pivot that their buckets name."""
    n, seen, unions, plain, bound = 60, [0], [0], ngram.compared, ngram.bounded
    base = list(range(400))
    tokens = {"root": set(base)} | {f"s{k}": set(base[:250]) | set(range(1000, 1100)) | {5000 + 20 * k + j for j in range(10)} for k in range(n)}

    def counting(pairs, sets):
        kept = ngram.stored(pairs.select("a", "b"), "counted")
        seen[0] += kept.count()
        return plain(kept, sets)

    def counting_unions(asked, matrix, place):
        unions[0] += asked.count()
        return bound(asked, matrix, place)

    monkeypatch.setattr(ngram, "compared", counting)
    monkeypatch.setattr(ngram, "bounded", counting_unions)
    links = ngram.links_of(made_sets(spark, tokens, dict.fromkeys(tokens, 1), {"root": 1.0}))
    parts = rows(components.components(links))
    assert len(parts) == n and len({bytes(x["component"]) for x in parts}) == 1
    assert seen[0] <= 6 * n and unions[0] <= n


def test_overlaps_with_unions_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram, "UNION_TOKENS", 8)
    matrix = [(b"f", t, c, k) for c, k, own in ((b"a", b"a", range(30)), (b"b", b"b", range(10, 40)), (b"c", b"b", range(20, 60)), (b"d", b"d", range(100, 103))) for t in own]
    matrix = spark.createDataFrame([(bytearray(f), t, bytearray(c), bytearray(k)) for f, t, c, k in matrix], "frame binary, token long, class binary, cluster binary")
    asked = spark.createDataFrame([(bytearray(b"f"), bytearray(c), bytearray(o)) for c, o in ((b"a", b"b"), (b"b", b"a"), (b"c", b"a"), (b"d", b"b"))], "frame binary, class binary, other binary")
    found = {(bytes(x["class"]), bytes(x["other"])): x["both"] for x in rows(ngram.bounded(asked, matrix, ["frame", "token"]))}
    assert found == {(b"a", b"b"): 20, (b"b", b"a"): 20, (b"c", b"a"): 10, (b"d", b"b"): 0}
