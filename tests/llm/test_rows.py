"""The other operators: brute force, round trips, held-out accuracy, laws."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from cases import EDGES, LONG, prose, rows, table, words
from pyspark.sql import functions as F

from lodestar.llm import bpe, langid, media, mixing, quality, sharding, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")


def sample(frame):
    return {x["doc_id"]: x for x in rows(frame)}


# Language


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", "ba", "aba", "▁a"])
    table_ = np.random.default_rng(1).random((len(lattice.hashes), 2))
    table_[0] = 0

    def all_ways(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in lattice.pieces:
                total += table_[1 + lattice.pieces.index(word[:k]), lang] * all_ways(word[k:], lang)
            elif k == 1:
                total += langid.UNKNOWN * all_ways(word[1:], lang)
        return total

    for word in ("▁abab", "▁aba?", "ba"):
        found = np.exp(langid.log_probabilities(lattice, table_, [word.removeprefix("▁")] if word[0] == "▁" else [word]))
        expected = [all_ways("▁" + word.removeprefix("▁"), k) for k in (0, 1)]
        assert found[0] == pytest.approx(expected)


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    from lodestar.llm import queries

    found = queries.op1_langid(spark, folder).where("held_out").join(queries.documents(spark, folder).select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_of_edge_rows(spark):
    df = table(spark, [*EDGES, (20, "123 ... 456", None, None)])
    model = langid.fit(df.withColumn("lang", F.when(F.col("doc_id") == 20, None).otherwise(F.col("lang"))), ["a", "b", "▁w"])
    found = rows(langid.predict(df, model))
    assert len(found) == len(EDGES) + 1 and all(0 <= x["score"] <= 1 for x in found)
    by = {x["doc_id"]: x["lang_pred"] for x in found}
    assert by[1] == by[2] == by[3] == by[20] == "und" and by[4] == by[5] == "en"
    empty = df.limit(0)
    assert rows(langid.predict(empty, langid.fit(empty, ["a"]))) == []


def test_fit_is_expectation_maximisation(spark):
    """Two rounds over all segmentations of three words, listed one by one."""
    pieces = ["a", "b", "ab", "ba", "▁a", "▁ab"]
    df = table(spark, [(1, "ab ab"), (2, "aba"), (3, "bb")])
    model = langid.fit(df, pieces, rounds=2)

    def ways(word):
        if not word:
            return [[]]
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in pieces or k == 1 for rest in ways(word[k:])]

    prob = dict.fromkeys(pieces, 1 / (len(pieces) + 1))
    for _ in range(2):
        counts = Counter()
        for word, n in (("▁ab", 2), ("▁aba", 1), ("▁bb", 1)):
            weights = [math.prod(prob.get(p, langid.UNKNOWN) for p in way) for way in ways(word)]
            for way, weight in zip(ways(word), weights, strict=True):
                for p in way:
                    counts[p] += n * weight / sum(weights)
        prob = {p: counts[p] + 0.02 for p in pieces}
        prob = {p: v / sum(prob.values()) for p, v in prob.items()}
    assert dict(zip(model["pieces"], model["table"][1:, 0].tolist(), strict=True)) == pytest.approx(prob, rel=1e-5)


def test_letters_of_any_script_and_numbers_that_are_none():
    assert langid.words_of("½ ² ① Ⅳ 42 _") == []
    assert langid.words_of("हिन्दी में Straße É2é") == ["हिन्दी", "में", "straße", "é", "é"]


def test_numbers_have_no_language(spark):
    df = spark.createDataFrame([(1, "½ ² ①", "es"), (2, "hola", "es"), (3, "hallo", "de")], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in rows(langid.predict(df, langid.fit(df, ["h", "o", "l", "a"])))}
    assert (found[1]["lang_pred"], found[1]["score"]) == ("und", 0.0) and found[2]["lang_pred"] == "es"


def test_crowded_and_very_long_pieces():
    lattice = langid.Lattice([chr(97 + k % 26) * (1 + k // 26) for k in range(26 * 40)])
    assert lattice.chunk == 40 and lattice.matches(["q" * 40])[0, 40][0].tolist() == [0]


def test_long_pieces_and_words():
    long = "abcdefghijklmnop"
    lattice = langid.Lattice([long, "a", "B", long[:9] + "x"])
    assert lattice.longest == 16 and "b" in lattice.pieces
    (rows_, numbers) = lattice.matches(["z" + long, "z" * 17])[1, 16]
    assert rows_.tolist() == [0] and lattice.pieces[numbers[0] - 1] == long
    table_ = np.full((len(lattice.hashes), 1), 0.1)
    counts = langid.expected_counts(lattice, table_[:, 0], ["z" * 30 + "a"], [1])
    assert counts[1 + lattice.pieces.index("a")] == pytest.approx(1)  # beyond the first stretch


# WARC


def pages_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, date string, html string").repartition(2)


def test_pages_through_archives(spark):
    pages = [(k, f"http://x/{k}", "20200102030405", h) for k, h in enumerate(["same", None, "", "same", "ü" * 5, "a\nb\r\n\r\nc" * 1000, "same"])]
    pages += [(3, "http://x/3", None, "same"), (None, None, None, "same"), (None, "http://a b", "199912", "alone"), (0, "http://x/0", None, "same"), (50, "u", None, LONG)]
    arc = pages_of(spark, pages)
    found = warc.read_warc(warc.convert(warc.stored(warc.write_arc(arc), "arc")))
    expected = []
    for number, _, _, html in pages:
        data = (html or "").encode()
        numbers = [p for p, _, _, h in pages if (h or "").encode() == data and p is not None]
        first = min(numbers, default=None)
        again = first is not None and (number != first or any(e[0] == number and e[2] == base64.b32encode(hashlib.sha1(data).digest()).decode() for e in expected))
        expected.append((number, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert warc.write_arc(arc.limit(0)).count() == 0
    archives = warc.convert(warc.stored(warc.write_arc(arc), "arc"))
    ids = [h["warc-record-id"] for x in archives.collect() for h, _ in warc.warc_records(bytes(x["content"]))]
    refers = [h["warc-refers-to"] for x in archives.collect() for h, _ in warc.warc_records(bytes(x["content"])) if "warc-refers-to" in h]
    assert len(set(ids)) == len(ids) == len(pages) and set(refers) <= set(ids)
    none = warc.convert(warc.stored(warc.write_arc(arc.limit(0)), "arc"))
    assert rows(none) == [] and rows(warc.read_warc(none)) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    writer = warc.ArcWriter("x.arc", version)
    writer.add(7, "http://a b\tc", "19990102030405", b"pay\nload")
    (fields, body), = warc.arc_records(writer.content())
    assert fields["URL"] == "http://a%20b%09c" and fields["Archive-date"] == "19990102030405" and len(fields) == (5, 10)[version - 1]
    headers, block = next(warc.warc_records(warc.warc_record(fields, body, "<a>")))
    assert headers["warc-date"] == "1999-01-02T03:04:05Z" and headers["warc-type"] == "response" and warc.http_parts(block)[2] == b"pay\nload"
    headers, block = next(warc.warc_records(warc.warc_record(fields, body, "<a>", (3, "<b>"))))
    assert headers["warc-refers-to"] == "<b>" and headers["x-refers-to-page-id"] == "3" and headers["warc-record-id"] == "<a>" and warc.http_parts(block)[2] == b""
    with pytest.raises(ValueError):
        list(warc.arc_records(writer.content()[:-1] + b"x"))


# BPE


def test_ids_are_tiktokens(spark):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {p: k for k, p in enumerate(bpe.read_ranks(path))}
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["don't  stop\n\n\tnow 12345", "x" * 5000, "▁▁ lower▁bar", "\x1c\x1d a\x85b c", "日本語のテキスト", "<|endoftext|>", "Ünḯ ​ ﻿", "🙂" * 50, " " * 300]
    odd.append("".join(f"a{chr(c)}b {chr(c)}{chr(c)}c" for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF]))
    df = table(spark, [*EDGES, *enumerate(odd, 100)])
    found = rows(bpe.decode(bpe.encode(df, path, tokenizers.PATTERN), path))
    assert len(found) == len(EDGES) + len(odd)
    for x in found:
        text = x["text"] or ""
        assert np.frombuffer(x["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(x["decoded"]) == text.encode()
    assert rows(bpe.encode(df.limit(0), path, tokenizers.PATTERN)) == []


# Sharding


def brute_shard(key, tree):
    """The descent of the tree, with Spark's chained hashes from the xxhash library."""

    def draw(level, name, weight):
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        h = xxhash.xxh64_intdigest(name.encode() if isinstance(name, str) else name.to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def best(level, names, weights):
        return min((draw(level, n, w), k) for k, (n, w) in enumerate(zip(names, weights, strict=True)) if w > 0)[1]

    r = best("region", range(len(tree.regions)), [sum(w for rack in region for _, w in rack) for region in tree.regions])
    region = tree.regions[r]
    rack = region[best("rack", [f"{r}/{k}" for k in range(len(region))], [sum(w for _, w in rack) for rack in region])]
    return rack[best("shard", [s for s, _ in rack], [w for _, w in rack])][0]


def test_draws_as_by_brute_force(spark):
    tree = sharding.Tree((((((0, 1.0), (1, 3.0)), ((2, 4.0),)), (((3, 8.0), (4, 0.0)),))))
    keys = [*range(300), -5, 2**62, None]
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(F.col("k"), tree).alias("s")).collect()
    assert {r["k"]: r["s"] for r in found} == {k: brute_shard(k, tree) for k in keys}


def test_shards_keep_their_law(spark):
    tree = sharding.Tree.balanced(8)
    df = table(spark, [*EDGES, *[(k, "x" * (k % 50)) for k in range(100, 3100)]])
    found = rows(sharding.assign(df, tree, tree.with_region(8)))
    assert len(found) == len(EDGES) + 3000 and {x["shard"] for x in found} == set(range(8))
    assert all(x["grown_shard"] in (x["shard"], 8) for x in found) and 200 < sum(x["grown_shard"] == 8 for x in found) < 500
    for s in range(8):
        assert sorted(x["slot"] for x in found if x["shard"] == s) == list(range(sum(x["shard"] == s for x in found)))
    texts = {d: t for d, t in EDGES}
    for x in found:
        if x["doc_id"] in texts and x["doc_id"] is not None:
            data = (texts[x["doc_id"]] or "").encode()
            assert (x["size"], x["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert rows(sharding.assign(df.limit(0), tree, tree)) == []


def test_weights_and_confinement(spark):
    tree = sharding.Tree((((((0, 1.0), (1, 3.0)), ((2, 4.0),)), (((3, 8.0), (4, 0.0)),))))
    heavier = sharding.Tree((((((0, 1.0), (1, 3.0)), ((2, 6.0),)), (((3, 8.0), (4, 0.0)),))))
    keys = spark.range(20_000).select("id", sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    share = Counter(x["a"] for x in keys)
    assert 4 not in share and all(abs(share[s] / 20_000 - w / 16) < 0.02 for s, w in enumerate((1, 3, 4, 8)))
    moved = {(x["a"], x["b"]) for x in keys if x["a"] != x["b"]}
    assert moved <= {(3, 0), (3, 1), (3, 2), (0, 2), (1, 2)}  # only into the subtree that gained weight


# Quality


def brute_counts(text):
    t = text or ""
    w = t.encode().split()
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    r = random.Random(5)
    repeated = " ".join(r.choice(["a", "b"]) for _ in range(60))
    noise = "".join(chr(r.randrange(33, 0x2FFF)) + " " * (k % 7 == 0) for k in range(3000))
    df = table(spark, [*EDGES, (20, "same words again and again " * 40), (21, repeated), (22, noise), (23, "# a | b\nx\nx\n\n#")])
    found = rows(quality.judge(df))
    text_of = {d: t for d, t in [*EDGES, (20, "same words again and again " * 40), (21, repeated), (22, noise), (23, "# a | b\nx\nx\n\n#")]}
    assert len(found) == len(EDGES) + 4
    for x in found:
        if x["doc_id"] is None:
            continue
        t = text_of[x["doc_id"]]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)
        assert x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]) and not (x["base_failed"] and x["kept"])
        if t:
            assert x["ratio"] == len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(t.encode())) / len(t.encode())
    by = {x["doc_id"]: x for x in found}
    for k, t in ((5, LONG), (22, noise)):
        assert by[k]["n_chunks"] == -(-len(t.encode()) // quality.CHUNK)
    assert by[5]["kept"] and not by[20]["kept"] and not by[22]["kept"] and by[5]["n_chunks"] > 10
    assert rows(quality.judge(df.limit(0))) == []


# Media


def plain_items(page):
    return [(i["position"], i["kind"], i["text"], i["caption"], i["digest"]) for i in media.items_of(page)]


def test_items_keep_positions_and_captions():
    page = '<p>one <b>two</b></p><script>no</script><figure><img src="sha256:aa" alt="z"><figcaption>cap &amp; x</figcaption></figure>mid<img src="sha256:bb" alt="alone"><img src="http://x/y.png"><p>end'
    assert plain_items(page) == [(0, "text", "one two", None, None), (1, "media", None, "cap & x", "aa"), (2, "text", "mid", None, None), (3, "media", None, "alone", "bb"), (4, "media", None, None, None), (5, "text", "end", None, None)]
    assert media.items_of(page)[4]["src"] == "http://x/y.png" and media.items_of(None) == media.items_of("") == []


@pytest.mark.parametrize(
    "page, items",
    [
        ("<figure><img src=a><figcaption>cap<p>rest</p></figure><p>more</p>", [("media", "cap"), ("text", "rest"), ("text", "more")]),
        ("<figure><figcaption><p>cap</p></figcaption><img src=a><img src=b></figure>x", [("media", "cap"), ("media", "cap"), ("text", "x")]),
        ("<figcaption>alone</figcaption>y", [("text", "alone"), ("text", "y")]),
        ("<figure><img src=a alt=other><figcaption>open", [("media", "open")]),
        ("<figure><img src=a><figcaption>one</figcaption><figcaption>two</figcaption></figure>", [("media", "one"), ("text", "two")]),
        ("<figure><img src=a></figure></figure><p>x", [("media", None), ("text", "x")]),
    ],
)
def test_captions_end(page, items):
    assert [(kind, caption if kind == "media" else text) for _, kind, text, caption, _ in plain_items(page)] == items


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<noscript>hello<p>rest of page", ["hello", "rest of page"]),
        ("<p>one</p><title>unclosed <p>two</p><p>three</p>", ["one", "two", "three"]),
        ("<script>var a = 1 <p>two</p><title>t</title>x", ["two", "x"]),
        ("<style>p {} <div>two", ["two"]),
        ("<template><p>kept</p></template>after", ["kept", "after"]),
        ("<SCRIPT>a<b</script>x<title>y</TITLE>z", ["xz"]),
        ("<title>never ends", []),
        ("a<script>b</script>c<script>d", ["ac"]),
    ],
)
def test_elements_without_an_end_lose_no_page(page, texts):
    assert [text for _, kind, text, _, _ in plain_items(page) if kind == "text"] == texts


def test_shared_images(spark):
    """Many rows refer to the image of their source; a row without one doesn't."""
    docs = spark.createDataFrame([(k, f"text {k}", None if k == 4 else f"src{k % 2}") for k in range(5)], "doc_id long, text string, source string")
    for x in rows(media.columns_of_texts(docs, shared="source")):
        kinds = [(i["kind"], i["caption"]) for i in x["items"]]
        top = [("media", f"src{x['doc_id'] % 2}")] if x["doc_id"] != 4 else []
        assert kinds == [*top, ("text", None), ("media", "lines 1 to 1 of 1")]
        if top:
            assert x["items"][0]["payload"]["payload_sha256"] == media.digest_of(f"src{x['doc_id'] % 2}")


def test_media_of_texts(spark):
    found = rows(media.columns_of_texts(table(spark, EDGES)))
    assert len(found) == len(EDGES)
    text_of = dict(EDGES)
    for x in found:
        references = [i for i in x["items"] if i["kind"] == "media"]
        assert [i["position"] for i in x["items"]] == list(range(len(x["items"]))) and references
        if x["doc_id"] is not None:
            text = text_of[x["doc_id"]] or ""
            data, n = media.padded(text_of[x["doc_id"]])
            assert len(data) % 192 == 0 and data and x["n_bytes"] == n == len(text.encode())
            assert [i["text"] for i in x["items"] if i["kind"] == "text"] == [y for y in (" ".join(z.split()) for z in text.split("\n")) if y]
            assert references[-1]["caption"].endswith(f" of {len(text.split(chr(10)))}") and len(references) == -(-len(text.split("\n")) // media.SECTION)
            for p in (i["payload"] for i in references):
                assert (p["payload_bytes"], p["payload_sha256"], p["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
                assert (p["media_bytes"], p["media_sha256"]) == (len(media.to_pgm(data)), hashlib.sha256(media.to_pgm(data)).hexdigest())
    assert rows(media.columns_of_texts(table(spark, EDGES).limit(0))) == []
    named = table(spark, [(1, "a\nb")]).withColumn("name", F.lit("k1"))
    assert [x["name"] for x in rows(media.columns_of_texts(named, key="name", keep_text=False))] == ["k1"]


def test_unknown_references(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><img src="sha256:zz">'), (2, "text"), (3, None)], "row long, html string")
    payloads = spark.createDataFrame([("aa", (5,))], "digest string, payload struct<n:int>")
    found = {x["row"]: [i["payload"] for i in x["items"]] for x in rows(media.resolve(media.sequences(pages), payloads, "row"))}
    assert found == {1: [{"n": 5}, None], 2: [None], 3: []}
    with pytest.raises(ValueError):
        media.from_pgm(b"P5\n192 1\n255\nshort")


# Mixing


def brute_poisson(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_counts_are_inverted(spark):
    df = table(spark, [(k, f"t{k}", "en", "ab"[k % 3 == 0]) for k in range(600)] + [(600, None, None, None)] * 2)
    rates = spark.createDataFrame([("a", 0.4), ("b", 3.5), (None, 450.0), ("c", 1.0)], "source string, rate double")
    found = rows(mixing.replicate(df, rates))
    u = lambda d, piece: (int(hashlib.md5(f"mix:{d}:{piece}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    for d in range(600):
        own = sorted(x["copy"] for x in found if x["doc_id"] == d)
        assert own == list(range(brute_poisson((0.4, 3.5)[d % 3 == 0], u(d, 1))))
    assert sum(x["doc_id"] == 600 for x in found) == 2 * sum(brute_poisson(150.0, u(600, j)) for j in (1, 2, 3))
    assert sorted(map(str, rows(mixing.replicate(df.repartition(7), rates)))) == sorted(map(str, found))
    plan = mixing.replicate(df, rates)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_rates_reach_the_target(spark):
    df = table(spark, [(k, "t", "en", "big" if k % 10 else "small") for k in range(5000)])
    sizes = mixing.source_sizes(df)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("none", 3.0)], "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(sizes, weights).collect()}
    assert rates == pytest.approx({"big": 2500 / 4500, "small": 2500 / 500})
    mixed = Counter(x["source"] for x in rows(mixing.replicate(df, mixing.repetition_rates(sizes, weights))))
    assert abs(mixed["big"] - 2500) < 250 and abs(mixed["small"] - 2500) < 250
    empty = df.limit(0)
    sizes = mixing.source_sizes(empty)
    assert rows(mixing.replicate(empty, mixing.repetition_rates(sizes, mixing.temperature_weights(sizes, 0.5)))) == []


# Toxicity


def brute_kernel(a, b):
    def spectrum(word):
        out = Counter()
        for order in toxicity.ORDERS:
            for places in itertools.combinations(range(len(word)), order):
                span = places[-1] - places[0] + 1
                letters = [word[p] for p in places]
                if span <= toxicity.SPANS[order] and all(c.isalpha() for c in letters):
                    out["".join(letters)] += toxicity.DECAY**span
        return out

    def own(word):
        return math.sqrt(sum(toxicity.DECAY ** (2 * (p[-1] - p[0] + 1)) for o in toxicity.ORDERS for p in itertools.combinations(range(len(word)), o) if p[-1] - p[0] < toxicity.SPANS[o] and all(word[k].isalpha() for k in p)))

    x, y = spectrum(a), spectrum(b)
    return sum(x[k] * y[k] for k in x) / own(a) / own(b)


def test_kernel_as_by_brute_force():
    strings = ["idiot", "id.iot", "iditot", "trashy", "banana"]
    found = toxicity.Landmarks(strings).kernel(strings)
    for j, a in enumerate(strings):
        for k, b in enumerate(strings):
            assert found[j, k] == pytest.approx(brute_kernel(a, b), rel=1e-5)


SENTENCES = [f"{a} {b} {c}" for a, b, c in zip(words(1, 50), words(2, 50), words(3, 50), strict=True)]
WINDOWS = [max(toxicity.strings(s), key=len) for s in SENTENCES]


def test_the_map_gives_the_kernel():
    """With the windows of all 50 sentences as landmarks, products of mapped windows are their kernel."""
    marks = toxicity.Landmarks(sorted({w for w in WINDOWS if len(w) > 2}))
    exact = np.array([[brute_kernel(a, b) for b in marks.words] for a in marks.words])
    z = marks.mapped(marks.words)
    assert np.abs(z @ z.T - exact).max() < 0.02


def test_the_machine_solves_its_problem():
    """The bound of the squared hinge, minimised by plain gradient descent over the exact kernel's dual weights, is reached."""
    marks = toxicity.Landmarks(sorted({w for w in WINDOWS if len(w) > 2}))
    labels = np.array(["a" in w for w in marks.words])
    weights, bias = marks.machine(marks.words, labels, np.ones(len(labels)))
    z = np.hstack([marks.mapped(marks.words), np.ones((len(labels), 1))])
    y, w, ridge = np.where(labels, 1.0, -1.0), np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-3)
    for _ in range(60_000):
        w -= 0.008 * (ridge * w - z.T @ (y * np.maximum(0, 1 - y * (z @ w))))
    assert toxicity.decisions(marks.words, weights, bias) == pytest.approx(z @ w, abs=2e-3)


def test_long_strings_are_learned_whole():
    long = "x" * 40 + "moronzu"
    assert all(len(w) <= toxicity.STRETCH for w in toxicity.strings(long)) and any("moronzu" in w for w in toxicity.strings(long))
    assert toxicity.strings("s c u m q u a x") == ["scumquax"]


def test_inserted_characters_are_found(spark):
    clean = [(k, prose(k, 80), None, None) for k in range(400)]
    toxic = [(1000 + k, prose(5000 + k, 40) + f" {['moronzu', 'scumquax'][k % 2]} " + prose(7000 + k, 40), None, None) for k in range(80)]
    df = table(spark, clean + toxic).withColumn("toxic", (F.col("doc_id") >= 1000).cast("int"))
    model = toxicity.fit(df)
    new = [(1, prose(9001, 60)), (2, prose(9002, 40) + " mor.onzu " + prose(9003, 9)), (3, prose(9004, 40) + " s c u m q u a x "), (4, "MORONZU!"), *[(10 + k, prose(9100 + k, 100)) for k in range(20)]]
    found = sample(toxicity.score(table(spark, new), model))
    assert [found[k]["predicted"] for k in (1, 2, 3, 4)] == [0, 1, 1, 1] and sum(found[k]["predicted"] for k in range(10, 30)) == 0


def test_toxicity_from_a_small_sample_of_many_rows(spark):
    docs = [(k, prose(k, 12) + (f" {['moronzu', 'scumquax'][k // 10 % 2]} " if k % 10 == 0 else ""), None, None) for k in range(12_000)]
    df = table(spark, docs).withColumn("toxic", (F.col("doc_id") % 10 == 0).cast("int"))
    new = [(1, prose(50_001, 30) + " moronzu"), (2, prose(50_002, 30) + " scumquax"), *[(10 + k, prose(50_100 + k, 30)) for k in range(30)]]
    found = sample(toxicity.score(table(spark, new), toxicity.fit(df, documents=110)))
    assert [found[k]["predicted"] for k in (1, 2)] == [1, 1] and sum(found[k]["predicted"] for k in range(10, 40)) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_toxicity_from_few_toxic_rows(spark, n):
    docs = [(k, prose(k, 40), None, None) for k in range(300)] + [(1000 + k, prose(5000 + k, 10) + " moronzu " + prose(7000 + k, 10), None, None) for k in range(n)]
    df = table(spark, docs).withColumn("toxic", (F.col("doc_id") >= 1000).cast("int"))
    new = [(1, prose(9001, 20) + " moronzu"), *[(10 + k, prose(9100 + k, 20)) for k in range(20)]]
    for documents in (15_000, 30):
        found = sample(toxicity.score(table(spark, new), toxicity.fit(df, documents=documents)))
        assert sum(found[k]["predicted"] for k in range(10, 30)) == 0
        if n > 1:  # one document alone doesn't tell which of its words is the insult
            assert found[1]["score"] > max(found[k]["score"] for k in range(10, 30))


def test_toxicity_of_copies_of_one_text(spark):
    docs = [(k, prose(k, 40), None, None) for k in range(300)] + [(1000 + k, prose(5000, 20) + " moronzu", None, None) for k in range(100)]
    df = table(spark, docs).withColumn("toxic", (F.col("doc_id") >= 1000).cast("int"))
    found = rows(toxicity.score(df, toxicity.fit(df, documents=20)))
    assert all(x["predicted"] for x in found if x["doc_id"] >= 1000) and sum(x["predicted"] for x in found if x["doc_id"] < 1000) < 100


def test_toxicity_without_a_sign_is_the_share(spark):
    docs = [(k, "alpha beta", None, None) for k in range(40)]
    df = table(spark, docs).withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    found = rows(toxicity.score(df, toxicity.fit(df)))
    assert all(x["score"] == pytest.approx(0.25) and x["predicted"] == 0 for x in found)


def test_toxicity_of_edge_rows(spark):
    df = table(spark, EDGES)
    for label in (None, 0, 1):
        model = toxicity.fit(df.withColumn("toxic", F.lit(label).cast("int")))
        found = rows(toxicity.score(df, model))
        assert len(found) == len(EDGES) and all(0 <= x["score"] <= 1 and x["predicted"] == (label or 0) for x in found)
    assert rows(toxicity.score(df.limit(0), toxicity.fit(df.limit(0).withColumn("toxic", F.lit(1))))) == []


def test_names_with_underscores_may_clash(spark):
    from lodestar.llm import linededup

    names = ("_key", "_digest", "_runs", "_source", "_pieces", "_cdf", "_count", "_guess", "guess", "_bucket")
    df = spark.createDataFrame([(k, prose(k % 3, 80), "en", "s", *names) for k in range(6)], ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"{n} string" for n in names]]))
    rates = spark.createDataFrame([("s", 2.0)], "source string, rate double")
    model = langid.fit(df, ["a", "b"])
    for made in (linededup.dedup(df), mixing.replicate(df, rates), langid.predict(df, model), toxicity.score(df, toxicity.fit(df.limit(0).withColumn("toxic", F.lit(1))))):
        found = rows(made)
        assert found and all(x[n] == n for x in found for n in names)


def test_words_helper():
    assert words(1, 3) == words(1, 3)
