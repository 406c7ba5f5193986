"""The training-data queries; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, langid, linededup, media, mixing, ngram, quality, search, secrets, sharding, toxicity, warc
from .shared import stored


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def remainder(column: str, divisor: int):
    """crc32 of a number as text, modulo a divisor: what deals rows to folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of the labelled ones."""
    import public_tokenizers

    docs = documents(spark, folder).select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(docs.where("not held_out"), pieces)
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as ARC archives, converted to WARC archives, and read back."""
    when = F.date_format(F.timestamp_seconds(946684800 + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(700_000_000))), "yyyyMMddHHmmss")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", when.alias("date"), "html")
    arc = stored(warc.write_arc(pages), "warc-arc", large_rows=True)
    return warc.read_warc(warc.convert(arc))


def op3_ngram(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components at 0.75 of five-word shingles."""
    return ngram.near_duplicates(documents(spark, folder))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards in two regions of two racks; a ninth would come in a region of its own."""
    tree = sharding.Tree.balanced(8)
    return sharding.assign(documents(spark, folder).select("doc_id", "text"), tree, tree.with_region(8))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and compression bands of every document."""
    return quality.judge(documents(spark, folder))


def op7_linededup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the later copies of line runs of 50 words or more."""
    return linededup.dedup(documents(spark, folder).select("doc_id", "text"))


def _counted(items) -> list:
    """What a sequence holds: numbers of blocks and references, characters of the blocks, and a letter for each item in order (t, m)."""
    kinds = F.transform(items, lambda i: F.substring(i["kind"], 1, 1))
    blocks = F.filter(items, lambda i: i["kind"] == "text")
    chars = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, i: n + i["n_chars"])
    return [F.size(blocks).alias("n_blocks"), (F.size(items) - F.size(blocks)).alias("n_references"), chars.alias("block_chars"), F.array_join(kinds, "").alias("sequence")]


def op8_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as an image in the page of its lines, under the image of its source: properties of both stored images, and the page's items in order."""
    found = media.columns_of_texts(documents(spark, folder), keep_text=False, shared="source")
    references = F.filter("items", lambda i: i["kind"] == "media")
    fields = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    last = F.element_at(references, -1)
    payload = [last["payload"][f].alias(f) for f in fields]
    of_source = F.when(F.size(references) > 1, F.get(references, F.lit(0))["payload"]["payload_sha256"]).alias("first_sha256")
    return found.select("doc_id", "n_bytes", *payload, last["caption"].alias("last_caption"), of_source, *_counted(F.col("items")))


def media_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The items of every web page: how many there are, in what order, and the digest of their texts."""
    pages = media.sequences(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"))
    items = F.transform("items", lambda i: i.withField("n_chars", F.length(i["text"])))
    words = F.array_join(F.transform("items", lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
    return pages.select("page_id", *_counted(items), F.sha2(words, 256).alias("text_sha256"))


def mixed(docs: DataFrame) -> DataFrame:
    """As many rows as there are, with sources weighted by the square root of their rows."""
    sizes = mixing.source_sizes(docs)
    return mixing.replicate(docs, mixing.repetition_rates(sizes, mixing.temperature_weights(sizes, 0.5)))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: every copy with its text and its place in the global shuffle."""
    return mixed(documents(spark, folder).select("doc_id", "source", "text"))


def toxicity_model(spark: SparkSession, folder: str) -> dict:
    """Learned from the labelled documents outside the held-out fifth."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    return toxicity.fit(documents(spark, folder).select("doc_id", "text").where(remainder("doc_id", 5) != 0).join(labels, "doc_id"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document."""
    docs = documents(spark, folder).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(docs, toxicity_model(spark, folder)).drop("text")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every whole text, and their decoding, as counts and digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(documents(spark, folder).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of a byte-level BPE and of a sentencepiece model lie over each other in every text."""
    import public_tokenizers

    return alignment.aligned(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that answer each benchmark item best, out of all."""
    docs = documents(spark, folder)
    return search.ranked(search.index(docs), spark.read.parquet(f"{folder}/benchmark.parquet"), query_key="item_id")


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets in every document: named ones, access keys, hexadecimal ones, and strings that look random."""
    return secrets.scanned(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_warc": op2_warc,
    "op3_ngram": op3_ngram,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_linededup": op7_linededup,
    "op8_media": op8_media,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_secrets": op13_secrets,
    "media_pages": media_pages,
}
SQL: dict[str, str] = {
    "op2_warc": """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bodies
""",
    "op3_ngram": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT steps.b, reach.least FROM reach JOIN steps ON reach.doc_id = steps.a WHERE reach.least < steps.b)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
""",
    "op7_linededup": r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM split),
counted AS (SELECT *, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
placed AS (SELECT doc_id, pos, line, upto, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM counted),
runs AS (
  SELECT a.doc_id, a.pos AS start, min(b.pos) AS stop FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.upto >= a.before + 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.pos) AS start, a.pos AS stop FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.before <= a.upto - 50 GROUP BY a.doc_id, a.pos),
named AS (SELECT runs.*, array_to_string(all_lines[start:stop], chr(10)) AS run FROM runs JOIN split USING (doc_id)),
later AS (SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM named) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(start, stop)) AS pos FROM later),
kept AS (SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.pos) FILTER (WHERE gone.pos IS NULL) AS rest, count(gone.pos) AS n FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.pos = gone.pos GROUP BY lines.doc_id)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text, coalesce(n, 0)::INT AS deleted_lines FROM documents LEFT JOIN kept USING (doc_id)
""",
    "op12_search": r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS big_n, sum(n)::HUGEINT AS big_l FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM held, whole),
parts AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75::HUGEINT * n * big_n) // big_l)::BIGINT))) AS part
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
    "op13_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f0 AS (SELECT r, 0 AS kind, 6 AS least, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS s, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v, string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p, text FROM d),
f1 AS (SELECT r, 1 AS kind, 0 AS least, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') AS s, s AS v, string_split_regex(text, 'AKIA[A-Z0-9]{16,}') AS p FROM d),
f2 AS (SELECT r, 2 AS kind, 0 AS least, regexp_extract_all(text, '[0-9a-f]{24,}') AS s, s AS v, string_split_regex(text, '[0-9a-f]{24,}') AS p FROM d),
m AS (SELECT r, kind, least, unnest(s) AS s, unnest(v) AS v, unnest(p[1:len(s)]) AS p, generate_subscripts(s, 1) AS i FROM (SELECT r, kind, least, s, v, p FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) WHERE len(s) > 0),
base AS (SELECT r, kind, stop - length(s) AS start, stop FROM (SELECT *, sum(length(p) + length(s)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS stop FROM m) WHERE length(v) >= least),
t0 AS (SELECT r, list_reduce(list_prepend('', list_transform(range(1, len(s) + 1), lambda i: p[i] || CASE WHEN length(v[i]) >= 6 THEN repeat(' ', length(s[i])) ELSE s[i] END)), lambda x, y: x || y) || p[-1] AS text FROM f0),
t1 AS (SELECT r, list_reduce(list_prepend('', list_transform(range(1, len(s) + 1), lambda i: p[i] || repeat(' ', length(s[i])))), lambda x, y: x || y) || p[-1] AS text FROM (SELECT r, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') AS s, string_split_regex(text, 'AKIA[A-Z0-9]{16,}') AS p FROM t0)),
t2 AS (SELECT r, list_reduce(list_prepend('', list_transform(range(1, len(s) + 1), lambda i: p[i] || repeat(' ', length(s[i])))), lambda x, y: x || y) || p[-1] AS text FROM (SELECT r, regexp_extract_all(text, '[0-9a-f]{24,}') AS s, string_split_regex(text, '[0-9a-f]{24,}') AS p FROM t1)),
c AS (SELECT r, unnest(s) AS s, unnest(p[1:len(s)]) AS p, generate_subscripts(s, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}') AS s, string_split_regex(text, '[A-Za-z0-9+/_-]{20,}') AS p FROM t2) WHERE len(s) > 0),
placed AS (SELECT r, s, sum(length(p) + length(s)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop FROM c),
coded AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '0123456789' WHEN regexp_matches(s, '^[0-9a-f]+$') THEN '0123456789abcdef' WHEN regexp_matches(s, '^[0-9A-F]+$') THEN '0123456789ABCDEF'
  WHEN regexp_matches(s, '^[a-z]+$') THEN 'abcdefghijklmnopqrstuvwxyz' WHEN regexp_matches(s, '^[A-Z]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' WHEN regexp_matches(s, '^[A-Z2-7]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
  WHEN regexp_matches(s, '^[a-z0-9]+$') THEN 'abcdefghijklmnopqrstuvwxyz0123456789' WHEN regexp_matches(s, '^[A-Z0-9]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' WHEN regexp_matches(s, '^[A-Za-z]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'
  WHEN regexp_matches(s, '^[A-Za-z0-9]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789' WHEN regexp_matches(s, '^[A-Za-z0-9+/]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'
  WHEN regexp_matches(s, '^[A-Za-z0-9_-]+$') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' END AS alphabet FROM placed),
read AS (SELECT *, length(s)::DOUBLE AS n, length(alphabet)::DOUBLE AS k, list_transform(range(1, length(s) + 1), lambda i: strpos(alphabet, s[i])::DOUBLE) AS v FROM coded WHERE alphabet IS NOT NULL),
summed AS (SELECT *, list_sum(list_transform(range(1, k::BIGINT + 1), lambda a: len(list_filter(v, lambda x: x = a))::DOUBLE ** 2)) AS squares, len(list_filter(v, lambda x: x > floor(k / 2)))::DOUBLE AS ones,
  1 + list_sum(list_transform(range(1, n::BIGINT), lambda i: ((v[i] > floor(k / 2)) <> (v[i + 1] > floor(k / 2)))::INT))::DOUBLE AS runs,
  list_sum(v) AS s1, list_sum(list_transform(v, lambda x: x * x)) AS s2, list_sum(list_transform(range(1, n::BIGINT + 1), lambda i: v[i] * v[i % n::BIGINT + 1])) AS sx FROM read),
tested AS (SELECT *, (k * squares / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, 2 * ones * (n - ones) / n + 1 AS mu,
  ((n * sx - s1 * s1) / nullif(n * s2 - s1 * s1, 0) + 1 / (n - 1)) * (n - 1) * sqrt(n - 2) / n AS serial, greatest(2 / k, 0.06::DOUBLE) AS usual FROM summed),
judged AS (SELECT r, s, stop, CASE WHEN n >= 128 THEN 3 WHEN n >= 64 THEN 2 WHEN n >= 32 THEN 1 ELSE 0 END AS size,
  greatest(-1000, least(0, ceil((squares - n - n * (n - 1) * usual) / sqrt(2 * n * (n - 1) * usual * (1 - usual)) * 50)))::BIGINT AS step,
  coalesce(chi * chi + (runs - mu) ** 2 / nullif((mu - 1) * (mu - 2) / (n - 1), 0) + serial * serial <= 16.266::DOUBLE, false) AS uniform FROM tested),
steps AS (SELECT size, step, count(DISTINCT s) AS n FROM judged GROUP BY ALL),
upto AS (SELECT size, step, sum(n) OVER (PARTITION BY size ORDER BY step) AS upto, sum(n) OVER (PARTITION BY size) AS whole, step / 50.0::DOUBLE AS z, 1 / (1 - 0.2316419::DOUBLE * step / 50.0::DOUBLE) AS t FROM steps),
limits AS (SELECT size, max(step) AS most FROM upto WHERE exp(-z * z / 2) / 2.5066282746310002::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) <= 0.01::DOUBLE * upto / whole GROUP BY size),
spans AS (SELECT r, kind, start, stop FROM base UNION ALL SELECT r, 3, stop - length(s), stop FROM judged JOIN limits USING (size) WHERE uniform AND step <= most),
told AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
""",
    "op9_mixing": """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sum(n) OVER () * sqrt(n) / sum(sqrt(n)) OVER () / n AS rate FROM sizes),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM rates, generate_series(0, 150) g(k)),
drawn AS (SELECT doc_id, source, text, (('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
counts AS (SELECT doc_id, u, count(*) AS n FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source AND steps.c <= u GROUP BY doc_id, u),
copies AS (SELECT doc_id, unnest(generate_series(0, n - 1))::INT AS copy FROM counts)
SELECT doc_id, source, text, copy, ('0x' || substr(md5('mix-order:' || doc_id || ':' || copy), 1, 13))::BIGINT AS mix_key FROM copies JOIN documents USING (doc_id)
""",
}
