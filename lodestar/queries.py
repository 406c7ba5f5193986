"""Queries over the test tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import answers, chat, prompts, statistics, text
from lodestar.operators import annotate, cluster, enrich, jsonkeys, judge, profile, ranking, sample, split, validate
from lodestar.operators.scratch import scratch
from lodestar.plans import convert, infer
from lodestar.session import table
from lodestar.sources import files, hub, json_items, sinks
from lodestar.streaming import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONFIG = infer.Config(data_source="documents", question="text", answer="answer", topic="lang", difficulty="n_chars", passthrough=("source",), strategy=split.Strategy("stratified", "lang"), extractor="after_hash4", prefix="documents")

# Expressions that several queries share, in SQL.
WORDS = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '\.$', '')"
MARKED = "text || ' #### ' || n_chars || '. '"
AFTER = f"CASE WHEN regexp_matches({MARKED}, '(?s)####\\s*(.+)$') THEN {WORDS.format(f'regexp_extract({MARKED}, ' + chr(39) + '(?s)####' + chr(92) + 's*(.+)$' + chr(39) + ', 1)')} ELSE {WORDS.format(MARKED)} END"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an answer after a mark."""
    return table(spark, folder, "documents").withColumn("answer", F.concat("text", F.lit(" #### "), "n_chars", F.lit(". ")))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Unified records of the documents: answers extracted, a stratified split, rows numbered in it."""
    return convert.converted({"train": marked(spark, folder)}, CONFIG, "doc_id")


# Answers


@query(f"SELECT doc_id, {AFTER} AS answer FROM documents")
def extract_after_hash4(spark, folder):
    return marked(spark, folder).select("doc_id", answers.extracted(F.col("answer"), "after_hash4").alias("answer"))


@query(rf"SELECT doc_id, coalesce(regexp_extract_all(text, '[-+]?\d*\.?\d+')[-1], {WORDS.format('text')}) AS answer FROM documents")
def extract_numeric(spark, folder):
    return table(spark, folder, "documents").select("doc_id", answers.extracted(F.col("text"), "numeric").alias("answer"))


@query(rf"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {WORDS.format('text')} ELSE 'f(' || n_chars || ')' END AS answer FROM documents")
def extract_boxed(spark, folder):
    mark = F.when(F.col("doc_id") % 3 != 0, F.concat("text", F.lit(" \\boxed{f("), "n_chars", F.lit(")} \\boxed{no}"))).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", answers.extracted(mark, "boxed").alias("answer"))


@query(r"SELECT page_id, regexp_extract(url, '(?s)^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '(?s)^https?://([^/]+)')")
def extract_regex_group1(spark, folder):
    pages = table(spark, folder, "pages").where(F.rlike("url", F.lit("^https?://([^/]+)")))
    return pages.select("page_id", answers.extracted(F.col("url"), "regex_group1", "^https?://([^/]+)").alias("host"))


@query(f"SELECT doc_id, {WORDS.format('text')} AS text FROM documents")
def norm_spaces(spark, folder):
    return table(spark, folder, "documents").select("doc_id", answers.extracted(F.col("text"), "copy").alias("text"))


@query(r"SELECT doc_id, regexp_replace('  ' || text || E' \n', '^\s+|\s+$', '', 'g') AS stripped, regexp_replace('  ' || text || E' \n', '\s+$', '') AS right_stripped FROM documents")
def strip(spark, folder):
    padded = F.concat(F.lit("  "), "text", F.lit(" \n"))
    return table(spark, folder, "documents").select("doc_id", text.strip(padded).alias("stripped"), text.rstrip(padded).alias("right_stripped"))


@query("SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars || 'e1' ELSE lang END AS DOUBLE) AS difficulty, CASE WHEN doc_id % 2 = 0 THEN n_chars || 'e1' ELSE lang END AS difficulty_text FROM documents")
def float_or_text(spark, folder):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat("n_chars", F.lit("e1"))).otherwise(F.col("lang"))
    rows = table(spark, folder, "documents").withColumns({"level": raw, "split": F.lit("train"), "index": F.col("doc_id")})
    info = convert.extra_info(rows, infer.Config("d", "text", "text", difficulty="level"))
    return rows.select("doc_id", info.alias("i")).select("doc_id", "i.difficulty", "i.difficulty_text")


# Splits and records

RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY md5('2025:' || {1}), {1}) AS place, count(*) OVER (PARTITION BY {0}) AS n"
SPLIT = "CASE WHEN place <= greatest(1, floor(n * 0.02::DOUBLE)) THEN 'val' ELSE 'train' END"


@query(f"SELECT o_orderkey, o_orderpriority, {SPLIT} AS split FROM (SELECT *, {RANKED.format('o_orderpriority', 'o_orderkey')} FROM orders)")
def split_stratified(spark, folder):
    return split.stratified_split(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query(f"SELECT doc_id, {SPLIT} AS split FROM (SELECT *, {RANKED.format('1', 'doc_id')} FROM documents)")
def split_random(spark, folder):
    return split.random_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS index FROM (SELECT doc_id, {SPLIT} AS split FROM (SELECT *, {RANKED.format('lang', 'doc_id')} FROM documents))")
def split_index(spark, folder):
    """Rows numbered within their split in the order of the files they come from, without a key for it."""
    docs = ranking.in_order(table(spark, folder, "documents").select("doc_id", "lang"))
    return split.indexed(split.stratified_split(docs, "doc_id", "lang"), "source_order").select("doc_id", "split", "index")


@query("SELECT doc_id, split FROM (SELECT doc_id, 'train' AS split FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'val' FROM documents WHERE doc_id % 10 = 0)")
def split_existing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return split.split(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "doc_id", split.Strategy("existing"))


@query(f"SELECT split, count(*) AS n FROM (SELECT {SPLIT} AS split FROM (SELECT *, {RANKED.format('lang', 'doc_id')} FROM documents)) GROUP BY split")
def split_sizes(spark, folder):
    return split.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "lang").groupBy("split").agg(F.count("*").alias("n"))


INSTRUCTION_SQL = infer.INSTRUCTION.replace("'", "''")


@query(
    f"""SELECT 'documents' AS data_source, 'user' AS role, regexp_replace(text, '\\s+$', '') || E'\\n\\n' || '{INSTRUCTION_SQL}' AS content, 'general' AS ability, 'rule' AS style,
    {AFTER} AS ground_truth, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS index, lang AS topic, n_chars::DOUBLE AS difficulty, source
    FROM (SELECT *, {SPLIT} AS split FROM (SELECT *, {RANKED.format('lang', 'doc_id')} FROM documents))"""
)
def unified_records(spark, folder):
    flat = chat.flattened(flagship(spark, folder), "reward_model", "extra_info")
    turn = F.get("prompt", F.lit(0))
    return flat.select(
        "data_source", turn["role"].alias("role"), chat.first_content(F.col("prompt")).alias("content"), "ability",
        *[F.col(f"`{p}.{c}`").alias(c) for p, c in (("reward_model", "style"), ("reward_model", "ground_truth"), *[("extra_info", x) for x in ("split", "index", "topic", "difficulty", "source")])],
    )


@query("SELECT 'prompt has a turn' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'turns are whole', count(*) FROM documents WHERE text IS NULL")
def validate_rows(spark, folder):
    return validate.violations(flagship(spark, folder))


@query("SELECT rule, n AS violations FROM (SELECT 'prompt has a turn' AS rule, (SELECT count(*) FROM conversations WHERE turn = 0 AND conv_id % 7 = 0) AS n UNION ALL SELECT 'turns are whole', (SELECT count(*) FROM conversations WHERE turn = 0 AND conv_id % 5 = 0 AND conv_id % 7 <> 0))")
def validate_violations(spark, folder):
    """Whole conversations; in some the first turn has no content, and some have no turns."""
    return validate.violations(conversation_records(spark, folder))


def conversation_records(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as records, by conv_id."""
    turn = F.struct("turn", "role", F.when((F.col("turn") != 0) | (F.col("conv_id") % 5 != 0), F.col("text")).alias("content"))
    whole = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    records = whole.select(
        "conv_id", F.lit("c").alias("data_source"), F.when(F.col("conv_id") % 7 != 0, turns).otherwise(F.array().cast("array<struct<role:string,content:string>>")).alias("prompt"),
        F.lit("general").alias("ability"), F.struct(F.lit(None).cast("string").alias("ground_truth")).alias("reward_model"), F.struct(F.lit(0).alias("index")).alias("extra_info"),
    )
    return records


# Samples and joins


@query("SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share, round_even(count(*) / (SELECT count(*) FROM documents)::DOUBLE * 500, 0)::BIGINT AS quota FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def category_share_alloc(spark, folder):
    return sample.allocation(table(spark, folder, "documents"), "lang")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def category_frequencies(spark, folder):
    return sample.frequencies(table(spark, folder, "documents"), "lang")


@query(f"SELECT lang, part, to_json(list(doc_id ORDER BY doc_id)) AS members FROM (SELECT lang, doc_id, ((place - 1) // 1000)::BIGINT AS part FROM (SELECT lang, doc_id, {RANKED.format('lang', 'doc_id')} FROM documents)) GROUP BY lang, part")
def category_members(spark, folder):
    """The keys of each category of all documents, in arrays of bounded size."""
    return sample.members(table(spark, folder, "documents"), "lang", "doc_id").withColumn("members", F.to_json("members"))


@query(f"SELECT lang, doc_id, place - 1 AS place FROM (SELECT lang, doc_id, {RANKED.format('lang', 'doc_id')} FROM documents)")
def category_membership(spark, folder):
    """The keys of each category as rows."""
    return sample.membership(table(spark, folder, "documents"), "lang", "doc_id")


QUOTAS = {"en": 40, "de": 20, "fr": 10, "xx": 5}
QUOTA_SQL = "(VALUES ('en', 40), ('de', 20), ('fr', 10), ('xx', 5)) q(lang, quota)"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('2025:' || doc_id), doc_id) AS place FROM documents JOIN {QUOTA_SQL} USING (lang)) WHERE place <= quota")
def quota_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sample.quota_sample(docs, sample.quota_table(docs, QUOTAS, "lang"), "lang", "doc_id")


@query(
    """WITH share AS (SELECT lang, round_even(count(*) / (SELECT count(*) FROM documents WHERE source <> 'src0')::DOUBLE * 100, 0)::BIGINT AS quota FROM documents WHERE source <> 'src0' GROUP BY lang),
    ranked AS (SELECT doc_id, lang, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('2025:' || doc_id), doc_id) AS place FROM documents JOIN share USING (lang) WHERE source <> 'src0')
    SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM ranked WHERE place <= quota)"""
)
def proportional_sample(spark, folder):
    return convert.proportional_sample(table(spark, folder, "documents"), "lang", "doc_id", 100, F.col("source") != "src0", ("source", "n_chars"))


@query(f"SELECT lang, quota::BIGINT AS quota FROM {QUOTA_SQL} WHERE lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def missing_quota_category(spark, folder):
    docs = table(spark, folder, "documents")
    return sample.missing_categories(sample.quota_table(docs, QUOTAS, "lang"), docs, "lang")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join_selected(spark, folder):
    return sample.full_rows(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, folder):
    return sample.without(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def enrich_join(spark, folder):
    return enrich.enriched(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id")


@query("SELECT c.key, c.name AS name_x, c.c_custkey, s.name AS name_y, s.s_suppkey FROM (SELECT c_nationkey AS key, c_name AS name, c_custkey FROM customer) c JOIN (SELECT s_nationkey AS key, s_name AS name, s_suppkey FROM supplier) s USING (key)")
def enrich_join_suffix(spark, folder):
    left = table(spark, folder, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), "c_custkey")
    right = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), "s_suppkey")
    return enrich.enriched(left, right, "key", many=True)


@query("SELECT a.key, a.doc_id, b.n FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id % 9 END AS key, doc_id FROM labels) a JOIN (SELECT key, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id % 9 END AS key FROM labels) GROUP BY key) b ON a.key IS NOT DISTINCT FROM b.key")
def enrich_join_nullsafe(spark, folder):
    left = table(spark, folder, "labels").select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 9).alias("key"), "doc_id")
    return enrich.enriched(left, left.groupBy("key").agg(F.count("*").alias("n")), "key", null_keys_match=True)


@query("SELECT event_id AS job FROM events WHERE event_type = 'click' UNION ALL (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')")
def union_all_distinct_b(spark, folder):
    events = table(spark, folder, "events")
    return cluster.job_list(events.where("event_type = 'click'").select(F.col("event_id").alias("job")), events.where("event_type = 'view'").select(F.col("user_id").alias("job")))


# Chat


@query("SELECT conv_id, to_json(list({role: role, content: text} ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id")
def messages_json(spark, folder):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return grouped.select("conv_id", F.to_json(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"))


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Question (the whole text), Answer, Think and ID out of documents and labels."""
    return labelled(spark, folder).select(F.col("doc_id").alias("ID"), F.col("text").alias("Question"), F.col("source").alias("Answer"), F.when(F.col("quality").isNotNull(), F.concat(F.lit(" q"), "quality")).alias("Think"))


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
WRAPPED = "'<think>' || coalesce('q' || quality, '') || '</think><answer>' || source || '</answer>'"


@query(f"SELECT doc_id AS id, to_json([{{role: 'system', content: 'Be exact.'}}, {{role: 'user', content: {STRIPPED}}}, {{role: 'assistant', content: {WRAPPED}}}]) AS messages FROM documents LEFT JOIN labels USING (doc_id)")
def think_answer_wrap(spark, folder):
    made = convert.chat_table(answered(spark, folder), "Be exact.")
    return made.withColumn("messages", F.to_json("messages"))


@query(f"SELECT doc_id AS id, to_json([{{role: 'user', content: {STRIPPED}}}, {{role: 'assistant', content: source}}]) AS messages FROM documents")
def plain_messages(spark, folder):
    return convert.chat_table(answered(spark, folder), tags=False).withColumn("messages", F.to_json("messages"))


@query(f"SELECT doc_id AS id, to_json([{{role: 'user', content: {STRIPPED}}}, {{role: 'assistant', content: '<think>' || coalesce('q' || quality, 'nan') || '</think><answer>' || source || '</answer>'}}]) AS messages FROM documents LEFT JOIN labels USING (doc_id)")
def nan_messages(spark, folder):
    return convert.chat_table(answered(spark, folder), nan_text=True).withColumn("messages", F.to_json("messages"))


@query(f"SELECT doc_id AS id, to_json({{question: {STRIPPED}, answer: {WRAPPED}}}) AS extra_info FROM documents LEFT JOIN labels USING (doc_id)")
def extra_info(spark, folder):
    return convert.question_table(answered(spark, folder)).withColumn("extra_info", F.to_json("extra_info"))


@query(f"SELECT doc_id AS id, {STRIPPED} AS question, {WRAPPED} AS answer FROM documents LEFT JOIN labels USING (doc_id)")
def flatten_extra(spark, folder):
    flat = chat.flattened(convert.question_table(answered(spark, folder)), "extra_info")
    return flat.toDF("id", "question", "answer")


@query("SELECT doc_id, to_json([{role: 'user', content: 'Q: ' || source || E'\\n{' || text || '}'}]) AS prompt FROM documents")
def prompt_template(spark, folder):
    prompt = F.array(chat.turn("user", chat.filled("Q: {source}\n{{{question}}}", source=F.col("source"), question=F.col("text"))))
    return table(spark, folder, "documents").select("doc_id", F.to_json(prompt).alias("prompt"))


@query("SELECT printf('doc-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id FROM documents WHERE lang = 'en'")
def gen_id(spark, folder):
    """Ids in the order of the files' rows."""
    kept = ranking.in_order(table(spark, folder, "documents")).where("lang = 'en'").select("doc_id", "source_order")
    return split.generated_ids(kept, "source_order", "doc").select("id", "doc_id")


@query("SELECT printf('page-%06d', row_number() OVER (ORDER BY page_id::VARCHAR || ':' || url) - 1) AS id, page_id FROM pages")
def gen_id_text_key(spark, folder):
    """Ids in the order of a key of text."""
    keyed = table(spark, folder, "pages").select("page_id", F.concat_ws(":", "page_id", "url").alias("key"))
    return split.generated_ids(keyed, "key", "page").select("id", "page_id")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang <> 'es'")
def dropna_subset(spark, folder):
    rows = labelled(spark, folder).withColumn("lang", F.when(F.col("lang") == "es", "N/A").otherwise(F.col("lang")))
    return validate.complete(rows.withColumn("lang", text.null_if_na(F.col("lang"))), "quality", "lang").select("doc_id", "quality")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source <> 'src1'")
def filter_empty(spark, folder):
    image = F.when(F.col("source") == "src1", F.lit(None)).when(F.col("lang") == "en", "").otherwise("x.png")
    return validate.without_value(table(spark, folder, "documents").withColumn("image", image), "image").select("doc_id", "lang")


# JSON


@query("SELECT event_id, 'k' AS key1, CASE WHEN event_id % 4 = 0 THEN 'event' ELSE '' END AS key2 FROM events")
def jsonl_keys(spark, folder):
    record = F.when(F.col("event_id") % 4 == 0, F.concat(F.expr("rtrim('}', props)"), F.lit(', "event": 1}'))).otherwise(F.col("props"))
    return jsonkeys.padded(table(spark, folder, "events").select("event_id", jsonkeys.keys(record).alias("keys")), "keys")


def verdict():
    """A response; in some a key is there twice, of which the last counts."""
    twice = F.when(F.col("event_id") % 5 == 0, '{"correct_answer": "first", "correct_answer": "a').otherwise('{"correct_answer": "a')
    return F.concat(twice, "user_id", F.lit('", "correct": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "confidence": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))


@query("SELECT event_id, 'e' || event_id AS id, 'a' || user_id AS correct_answer, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS correct, (event_id % 100)::VARCHAR AS confidence FROM events WHERE event_id % 4 <> 3")
def judge_flatten(spark, folder):
    name = F.concat(F.lit("e"), "event_id")
    keyed = F.concat(F.lit('{"'), name, F.lit('": {"judge_response": '), verdict(), F.lit('}, "other": 5}'))
    listed = F.concat(F.lit('[{"'), name, F.lit('": {"judge_response": '), verdict(), F.lit("}}, 3]"))
    plain = F.concat(F.lit('[{"id": "'), name, F.lit('", "judge_response": '), verdict(), F.lit('}, {"id": "y", "judge_response": null}]'))
    shape = F.when(F.col("event_id") % 4 == 0, keyed).when(F.col("event_id") % 4 == 1, listed).when(F.col("event_id") % 4 == 2, plain).otherwise("{broken")
    return judge.flattened(table(spark, folder, "events").withColumn("doc", shape), "doc", ("event_id",))


@query("SELECT 'e' || event_id AS id, 'a' || user_id AS correct_answer, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS correct, (event_id % 100)::VARCHAR AS confidence FROM events")
def judge_large_files(spark, folder):
    """The verdicts of all events in JSON files of 5,000, lists and objects, cut into items while they are read."""
    name = F.concat(F.lit("e"), "event_id")
    member = F.concat(F.lit('"'), name, F.lit('": {"note": "} \\\\ \\" {", "judge_response": '), verdict(), F.lit("}"))
    number = F.floor(F.col("event_id") / 5000)
    listed = number % 2 == 0
    row = F.when(listed, F.concat(F.lit("{"), member, F.lit("}"))).otherwise(member)
    events = table(spark, folder, "events").select(number.alias("file"), row.alias("row"))
    path = scratch(spark, "verdicts")
    events.groupBy("file").agg(F.array_join(F.collect_list("row"), ", \n").alias("rows")).select(
        F.when(F.col("file") % 2 == 0, F.concat(F.lit("["), "rows", F.lit("\n]"))).otherwise(F.concat(F.lit("{"), "rows", F.lit("}"))).alias("value"), "file"
    ).write.partitionBy("file").text(path)
    return judge.flattened_items(json_items.items(spark, f"{path}/*/*.txt")).drop("path")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def limit_first_100(spark, folder):
    """The first rows in the order of the files."""
    return sample.first(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), 100)


# Profiles


@query("SELECT * FROM (SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS \"column\", unnest([avg((doc_id IS NULL)::INT), avg((lang IS NULL)::INT), avg((quality IS NULL)::INT), avg((toxic IS NULL)::INT)]) AS missing_fraction FROM documents LEFT JOIN labels USING (doc_id))")
def missing_report(spark, folder):
    return profile.missing_report(labelled(spark, folder), "doc_id", "lang", "quality", "toxic")


@query("SELECT 'nation' AS \"table\", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\", unnest(['int64', 'object', 'int64']) AS dtype, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS example FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1)")
def data_dictionary(spark, folder):
    return profile.data_dictionary(table(spark, folder, "nation"), "nation", "n_nationkey")


T_SQL = "(1.959963984540054 + (1.959963984540054^3 + 1.959963984540054) / 4 / v + (5 * 1.959963984540054^5 + 16 * 1.959963984540054^3 + 3 * 1.959963984540054) / 96 / v^2)"


@query(
    f"""WITH long AS (SELECT l_returnflag, 'l_quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem),
    g AS (SELECT l_returnflag, metric, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, (count(*) - 1)::DOUBLE AS v FROM long GROUP BY ALL)
    SELECT l_returnflag, metric, n, round(m, 2) AS mean, round(m - {T_SQL} * s / sqrt(n), 2) AS low, round(m + {T_SQL} * s / sqrt(n), 2) AS high FROM g"""
)
def mean_ci95(spark, folder):
    return profile.mean_interval(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query(
    """WITH g AS (SELECT floor(sqrt(n_nationkey))::BIGINT AS squares, count(*) AS n, avg(n_nationkey) AS m, stddev_samp(n_nationkey) AS s FROM nation GROUP BY 1)
    SELECT squares, 'n_nationkey' AS metric, n, round(m, 2) AS mean, round(m - t * s / sqrt(n), 2) AS low, round(m + t * s / sqrt(n), 2) AS high
    FROM g JOIN (VALUES (1, NULL), (3, 4.302652729911275), (5, 2.7764451051977987), (7, 2.4469118511449692), (9, 2.306004135204166)) q(size, t) ON n = size"""
)
def mean_ci95_small(spark, folder):
    """Groups of one to nine rows, where the t quantile is far from the normal one."""
    nations = table(spark, folder, "nation").withColumn("squares", F.floor(F.sqrt("n_nationkey")))
    return profile.mean_interval(nations, "squares", "n_nationkey")


@query("SELECT quality, count(*) AS n, printf('%.2f%% +/- %.2f%%', 100 * avg(toxic), 100 * 1.96 * sqrt(avg(toxic) * (1 - avg(toxic)) / count(*))) AS accuracy FROM labels GROUP BY quality")
def wald_interval(spark, folder):
    half = statistics.wald_half(F.avg("toxic"), F.count("*"))
    return table(spark, folder, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.format_string("%.2f%% +/- %.2f%%", 100 * F.avg("toxic"), half).alias("accuracy"))


@query("SELECT c_custkey, round(c_acctbal * 47 / 100, 1) AS score FROM customer")
def scaled_score(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", statistics.scaled_score(F.col("c_acctbal"), 47).alias("score"))


@query("SELECT o_orderkey, floor(96 / 24)::BIGINT AS accumulation, floor(o_orderkey / 96.0::DOUBLE * 2)::BIGINT AS steps, floor(floor(o_orderkey / 96.0::DOUBLE * 2) / 50)::BIGINT AS saves, floor(floor(o_orderkey / 96.0::DOUBLE * 2) / 20)::BIGINT AS evaluations FROM orders")
def training_plan(spark, folder):
    plan = statistics.training_plan(F.col("o_orderkey"), F.lit(96), F.lit(2), F.lit(50), F.lit(20))
    return table(spark, folder, "orders").select("o_orderkey", *[c.cast("bigint").alias(n) for n, c in plan.items()])


@query("SELECT p_partkey, 'part_' || substr(sha256(p_brand), 1, 10) AS row_key FROM part")
def row_key(spark, folder):
    return table(spark, folder, "part").select("p_partkey", statistics.row_key("part_", F.col("p_brand")).alias("row_key"))


@query(r"SELECT DISTINCT p_type, regexp_replace(regexp_replace(p_type || ' - (#1)', '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, regexp_replace(lower(regexp_replace(p_type || ' - (#1)', '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS slug FROM part")
def colname_normalise(spark, folder):
    header = F.concat("p_type", F.lit(" - (#1)"))
    return table(spark, folder, "part").select("p_type", text.column_name(header).alias("name"), text.slug_column(header).alias("slug")).distinct()


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS short FROM documents")
def truncate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def base_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.base_name(F.col("url")).alias("base"))


@query("SELECT doc_id, '[' || source || '] ' || lang AS line, len(string_split(source || ',' || lang, ',')) ::BIGINT AS items FROM documents")
def line_prefix(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.prefixed_lines(F.col("source"), F.col("lang")).alias("line"), text.item_count(F.concat_ws(",", "source", "lang")).cast("bigint").alias("items"))


# Cluster text


@query("SELECT s_name AS NODE, 8 AS TOTAL, s_suppkey % 9 AS USED, 8 - s_suppkey % 9 AS FREE, CASE WHEN s_suppkey % 9 = 0 AND s_suppkey % 4 <> 0 THEN 'idle' WHEN s_suppkey % 9 < 8 THEN 'mix' ELSE 'alloc' END AS STATE FROM supplier")
def gpu_inventory(spark, folder):
    nodes = table(spark, folder, "supplier").select(F.col("s_name").alias("NODE"), F.when(F.col("s_suppkey") % 4 == 0, "gpu:X:8(S:0-1)").otherwise("gpu:X:8").alias("GRES"), F.format_string("gpu:X:%d(IDX:0-7)", F.col("s_suppkey") % 9).alias("GRES_USED"))
    return cluster.accelerators(nodes).withColumns({c: F.col(c).cast("bigint") for c in ("TOTAL", "USED", "FREE")})


@query("SELECT printf('%-20s %-10d %-10d %-10d %s', s_name, 8, s_suppkey % 9, 8 - s_suppkey % 9, CASE WHEN s_suppkey % 9 = 0 AND s_suppkey % 4 <> 0 THEN 'idle' WHEN s_suppkey % 9 < 8 THEN 'mix' ELSE 'alloc' END) AS value FROM supplier")
def gpu_report(spark, folder):
    return cluster.report_lines(gpu_inventory(spark, folder))


@query("SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY k) - 1)::BIGINT AS node_rank, 'n' || lpad(x::VARCHAR, 2, '0') AS node FROM (SELECT n_nationkey, unnest(list_concat(generate_series(n_nationkey, n_nationkey + 2), [90])) AS x, generate_subscripts(list_concat(generate_series(n_nationkey, n_nationkey + 2), [90]), 1) AS k FROM nation WHERE n_nationkey % 5 <> 0)")
def expand_nodelist(spark, folder):
    listed = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("n"), "n_nationkey")).otherwise(F.format_string("n[%d-%d,90]", "n_nationkey", F.col("n_nationkey") + 2))
    nodes = table(spark, folder, "nation").select("n_nationkey", listed.alias("nodes"))
    return cluster.expanded_nodes(nodes, "nodes").select("n_nationkey", F.col("node_rank").cast("bigint").alias("node_rank"), "node")


@query("SELECT s_suppkey, (right(s_name, 2)::INT + 8800)::BIGINT AS port FROM supplier")
def port(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", cluster.port(F.col("s_name")).cast("bigint").alias("port"))


# Annotation


SOLVE = prompts.PROMPTS["solve"]
SOLVE_SQL = "'" + SOLVE.replace("'", "''").replace("{problem}", "' || text || '") + "'"


@query(f"SELECT doc_id, 'reply:' || substr(md5({SOLVE_SQL}), 1, 8) AS answer FROM documents")
def annotate_stub(spark, folder):
    docs = table(spark, folder, "documents")
    return annotate.annotate(docs, chat.filled(SOLVE, problem=F.col("text")), "answer").select("doc_id", "answer")


@query(f"SELECT doc_id, 'reply:' || substr(md5({SOLVE_SQL}), 1, 8) AS answer FROM documents")
def annotate_resumed(spark, folder):
    """Replies to every distinct text, of which a first run has asked for those of half of the documents; the second asks for what is left."""
    docs, replies = table(spark, folder, "documents"), scratch(spark, "replies")
    prompt = chat.filled(SOLVE, problem=F.col("text"))
    annotate.annotate_once(docs.where("doc_id % 2 = 0"), prompt, "answer", replies)
    return annotate.annotate_once(docs, prompt, "answer", replies).select("doc_id", "answer")


@query("SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, n_chars FROM documents")
def json_lines(spark, folder):
    """Whole documents, with nulls, written as JSON lines and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "n_chars")
    return spark.read.schema(docs.schema).json(sinks.jsonl(docs, scratch(spark, "json-lines")))


@query("SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, 'say \"' || lang || '\", ' AS lang FROM documents")
def csv_round_trip(spark, folder):
    """Whole texts, and cells with quotes, commas and blanks at the end, written as CSV with a mark, and read back."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.concat(F.lit('say "'), "lang", F.lit('", ')).alias("lang"))
    return files.csv(spark, sinks.csv_with_mark(rows, scratch(spark, "csv")), "utf-8-sig")


@query("SELECT source, nullif(text, '') AS text, doc_id::VARCHAR AS doc_id FROM documents")
def csv_fields(spark, folder):
    """Chosen fields in an order of their own, as CSV, read back as text."""
    return files.csv(spark, sinks.csv(table(spark, folder, "documents"), scratch(spark, "csv-fields"), ["source", "text", "doc_id"]))


@query(f"""SELECT doc_id, role, content, split FROM (SELECT doc_id, 'user' AS role, regexp_replace(text, '\\s+$', '') || E'\\n\\n' || '{INSTRUCTION_SQL}' AS content, {SPLIT} AS split FROM (SELECT *, {RANKED.format('lang', 'doc_id')} FROM documents))""")
def parquet_records(spark, folder):
    """Unified records written to Parquet with their nested columns, and read back."""
    back = spark.read.parquet(sinks.parquet(flagship(spark, folder), scratch(spark, "records")))
    turn, info = F.get("prompt", F.lit(0)), F.col("extra_info")
    keys = split.indexed(split.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "lang"), "doc_id").select("doc_id", "split", "index")
    made = back.select(turn["role"].alias("role"), turn["content"].alias("content"), info["split"].alias("split"), info["index"].alias("index"))
    return made.join(keys, ["split", "index"]).select("doc_id", "role", "content", "split")


@query("""SELECT '{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || '  "lang" : ' || coalesce('"' || lang || '"', 'null') || ',' || chr(10) || '  "turn" : {' || chr(10) || '    "role" : "' || source || '"' || chr(10) || '  }' || chr(10) || '}' AS value FROM documents""")
def pretty_rows(spark, folder):
    """Each row as indented JSON, nulls and nested fields included."""
    docs = table(spark, folder, "documents")
    return sinks.pretty(docs.select("doc_id", "lang", F.struct(F.col("source").alias("role")).alias("turn")))


@query("SELECT sum(strlen(lang || ' ' || source) + 1) / 1e6::DOUBLE AS mb FROM documents")
def report_size(spark, folder):
    """Megabytes of the files of a report, logged as it is written."""
    lines = table(spark, folder, "documents").select(F.concat_ws(" ", "lang", "source").alias("value"))
    size = sinks.size_mb(lines, sinks.report(lines, scratch(spark, "report")))
    sinks.logger("lodestar").debug("report of %s MB", size)
    return files.rows(spark, [{"mb": size}], "mb double")


ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"
KANJI, KANA = "〇一二三四五六七八九", "ｱﾂﾎﾞソ能表ー～ヂア"  # half-width kana, characters with the byte of a backslash


@query(f"""SELECT doc_id::VARCHAR AS "番号", translate(n_chars::VARCHAR, '0123456789', '{KANJI}') AS "漢数字", CASE WHEN doc_id % 5 <> 0 THEN source || '"{KANA}",' || chr(10) || lang END AS "かな", nullif({ASCII_SQL}, '') AS text FROM documents""")
def csv_japanese(spark, folder):
    """Whole documents in the Japanese charset of spreadsheets, with numbers in kanji, and kana, quotes and line ends in cells, of which some are marked as missing; read back."""
    docs = table(spark, folder, "documents")
    kana = F.when(F.col("doc_id") % 5 != 0, F.concat("source", F.lit(f'"{KANA}",\n'), "lang")).otherwise("N/A")
    cells = docs.select(F.col("doc_id").alias("番号"), F.translate(F.col("n_chars").cast("string"), "0123456789", KANJI).alias("漢数字"), kana.alias("かな"), F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    path = sinks.csv(cells, scratch(spark, "csv-japanese"), encoding="cp932")
    return files.csv(spark, path, "cp932", na=text.NA_TOKENS)


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 0")
def json_lines_skipped(spark, folder):
    """Rows written as JSON lines without those whose text isn't UTF-8, and read back."""
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x"), F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("text"))
    path = sinks.jsonl(table(spark, folder, "documents").select("doc_id", broken.alias("text"), "lang"), scratch(spark, "json-lines"), skipped=scratch(spark, "skipped"))
    return spark.read.schema("doc_id long, text string, lang string").json(path)


KEYS_SQL = "SELECT r_regionkey::VARCHAR AS filename, 'first' AS key1, CASE WHEN r_regionkey % 2 = 0 THEN 'also' ELSE '' END AS key2 FROM region"


@query(KEYS_SQL)
def file_keys(spark, folder):
    """The keys of the first line of JSONL files, one for each region, written as a table of keys and read back, with cells that are empty."""
    first = F.when(F.col("r_regionkey") % 2 == 0, '{"first": 1, "also": 2}').otherwise('{"first": 1}')
    path = scratch(spark, "jsonl")
    table(spark, folder, "region").select(F.concat(first, F.lit('\n{"rest": 0}')).alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    found = files.first_line_keys(spark, f"{path}/*/*.txt", lambda p: F.regexp_extract(p, "r_regionkey=([0-9]+)/", 1))
    return files.csv(spark, sinks.key_table(found, scratch(spark, "keys"))).fillna("")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || chr(10) || n_nationkey AS value FROM nation")
def whole_files(spark, folder):
    """A file for each nation, read back as one text, line ends included."""
    path = scratch(spark, "files")
    lines = table(spark, folder, "nation").select(F.concat("n_name", F.lit("\n"), "n_nationkey").alias("value"), F.col("n_nationkey").alias("part"))
    lines.write.partitionBy("part").text(path)
    return files.documents(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("bigint").alias("n_nationkey"), F.rtrim(F.col("value"), F.lit("\n")).alias("value"))


@query("SELECT doc_id, lang, split FROM (SELECT doc_id, lang, " + SPLIT + " AS split FROM (SELECT *, " + RANKED.format("lang", "doc_id") + " FROM documents))")
def split_files(spark, folder):
    """Train and validation rows written to Parquet of their own, loaded by the format of their files, and chosen as splits."""
    made = split.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", "lang")
    train, val = sinks.split_parquet(made, scratch(spark, "splits"), "documents")
    loaded = files.load(spark, {"train": f"{train}/*.parquet", "validation": f"{val}/*.parquet"})
    chosen = files.chosen_splits(loaded, None, "validation")
    return split.split(*chosen, "doc_id", split.Strategy("existing"))


@query("SELECT 'j' || s_suppkey AS job, 'n' || (s_suppkey % 4) AS node, 'PD' AS state FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def job_table(spark, folder):
    """A captured job table, read from text and filtered by nodes, user and state."""
    line = F.format_string("%-10s j%d   n%d %s", F.when(F.col("s_suppkey") % 3 == 0, "me").otherwise("you"), "s_suppkey", F.col("s_suppkey") % 4, F.when(F.col("s_suppkey") % 2 == 0, "PD").otherwise("R"))
    header = spark.range(1).select(F.lit("USER JOB NODE STATE").alias("value"))
    path = sinks.report(header.unionByName(table(spark, folder, "supplier").select(line.alias("value"))), scratch(spark, "jobs"))
    jobs = files.command_output(spark, path, "USER", "JOB", "NODE", "STATE").toDF("user", "job", "node", "state")
    return files.jobs(jobs, nodes=["n1", "n2"], user="me", states=["PD"]).select("job", "node", "state")


@query("SELECT s_suppkey, 'n' || s_suppkey AS node FROM supplier")
def valid_nodes(spark, folder):
    """Node names with their prefix, after a check against the allowed ones."""
    names = cluster.valid_nodes(["n"], ["n", "m"])
    return table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit(names[0]), "s_suppkey").alias("node"))


@query("SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'und ') AS hit FROM documents")
def contains_any(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.contains_any(F.col("text"), ["The", "UND "]).alias("hit"))


BENCH_SQL = "(VALUES " + ", ".join(f"({k}, '{c}', {n})" for k, (c, n) in enumerate(sample.QUOTA.items())) + ") q(k, category, quota)"


@query(
    f"""WITH named AS (SELECT l_orderkey * 8 + l_linenumber AS key, category, quota FROM lineitem JOIN {BENCH_SQL} ON l_orderkey % 8 = k),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('2025:' || key), key) AS place FROM named)
    SELECT category, count(*) AS n, NULL::BIGINT AS expected, NULL::BOOLEAN AS complete FROM ranked WHERE place <= quota GROUP BY category
    UNION ALL SELECT NULL, count(*), 500, count(*) = 500 FROM ranked WHERE place <= quota"""
)
def quota_500(spark, folder):
    """The fixed quotas of eight categories, drawn exactly, and in a row without a category whether the sample has all of its 500 rows."""
    names = F.from_json(F.lit(json.dumps(list(sample.QUOTA))), "array<string>")
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.get(names, (F.col("l_orderkey") % 8).cast("int")).alias("category"))
    drawn = sample.quota_sample(lines, sample.quota_table(lines, sample.QUOTA), "category", "key", strict=False)
    return drawn.groupBy("category").agg(F.count("*").alias("n")).unionByName(sample.size_report(drawn, 500), allowMissingColumns=True)


@query(r"SELECT avg(regexp_full_match(CASE WHEN page_id % 4 = 0 THEN ' 3/4 ' WHEN page_id % 4 = 1 THEN page_id || '.5' ELSE url END, '\s*[-+]?(\d+(\.\d+)?|\d+/\d+)\s*')::INT) AS share FROM pages WHERE page_id % 7 <> 0")
def numeric_share(spark, folder):
    cell = F.when(F.col("page_id") % 4 == 0, " 3/4 ").when(F.col("page_id") % 4 == 1, F.concat("page_id", F.lit(".5"))).otherwise(F.col("url"))
    return profile.numeric_share(table(spark, folder, "pages"), F.when(F.col("page_id") % 7 != 0, cell))


@query("SELECT 'prompt has a turn' AS rule, count(*) FILTER (WHERE conv_id % 7 = 0) AS violations FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 50) UNION ALL SELECT 'turns are whole', 0")
def validate_first(spark, folder):
    """The rules on the first 50 records only."""
    turn = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    records = table(spark, folder, "conversations").select("conv_id").distinct().orderBy("conv_id").select(
        F.lit("c").alias("data_source"), F.when(F.col("conv_id") % 7 != 0, turn).otherwise(F.slice(turn, 1, 0)).alias("prompt"), F.lit("general").alias("ability"),
        F.struct(F.lit(None).cast("string").alias("ground_truth")).alias("reward_model"), F.struct(F.lit(0).alias("index")).alias("extra_info"),
    )
    return validate.violations(records, sample=50)


@query("SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'prompt has a turn,ground truth is there' WHEN conv_id % 5 = 0 THEN 'turns are whole' || CASE WHEN conv_id % 2 = 0 THEN ',ground truth is there' ELSE '' END WHEN conv_id % 2 = 0 THEN 'ground truth is there' ELSE '' END AS broken, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE n END AS turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def validate_quarantine(spark, folder):
    """Whole conversations as records, parted into good ones and those kept apart with the rules they break."""
    whole = conversation_records(spark, folder)
    truth = F.when((F.col("conv_id") % 7 != 0) & (F.col("conv_id") % 2 != 0), "yes")
    records_ = whole.withColumn("reward_model", F.struct(truth.alias("ground_truth")))
    good, bad = validate.quarantined(records_, scratch(spark, "quarantine"), {"ground truth is there": F.col("reward_model.ground_truth").isNotNull()})
    both = good.withColumn("broken", F.array().cast("array<string>")).unionByName(bad)
    return both.select("conv_id", F.array_join("broken", ",").alias("broken"), F.size("prompt").cast("bigint").alias("turns"))


@query("""SELECT unnest(['no train split', 'a question is missing', 'one split for both', 'a quota too high']) AS "case", unnest(['there is no train split', 'missing columns [''nothing'']', 'the only split, ''test'', can''t be both train and val', 'quotas above the number of rows']) AS message""")
def refusals(spark, folder):
    """Tables that are refused when the plan is made, each with what it is told."""
    docs = marked(spark, folder)
    config = infer.Config("d", "nothing", "answer")
    cases = {
        "no train split": lambda: convert.converted({"val": docs}, CONFIG, "doc_id"),
        "a question is missing": lambda: convert.converted({"train": docs}, config, "doc_id"),
        "one split for both": lambda: infer.inferred("d", {"test": docs}),
        "a quota too high": lambda: sample.quota_sample(docs, sample.quota_table(docs, {"en": 1 << 40}, "lang"), "lang", "doc_id"),
    }
    told = []
    for name, attempt in cases.items():
        try:
            attempt()
            told.append((name, "accepted"))
        except ValueError as refused:
            told.append((name, str(refused).split(";")[0].split(":")[0]))
    return spark.createDataFrame(told, "case string, message string")


@query("SELECT event_id AS index, event_type AS content, props AS ground_truth FROM events")
def events_stream(spark, folder):
    """Events as records, converted as their files arrive: a stream that has stopped, started again when the second half is there, each event once."""
    events, arriving = table(spark, folder, "events").select("event_id", "event_type", "props"), scratch(spark, "arriving")
    config = infer.Config("events", "event_type", "props", template="{question}", instruction="")
    out, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-checkpoint")
    made = None
    for part in (0, 1):
        sinks.jsonl(events.where(F.col("event_id") % 2 == part), f"{arriving}/part={part}")
        stream = records.json_stream(spark, f"{arriving}/*/", "event_id long, event_type string, props string")
        made = records.caught_up(records.unified_stream(stream, config, "event_id"), out, checkpoint)
    info = F.col("extra_info")
    return made.select(info["index"].alias("index"), chat.first_content(F.col("prompt")).alias("content"), "reward_model.ground_truth")


@query("""WITH first AS (SELECT * FROM documents ORDER BY doc_id LIMIT 3)
    SELECT unnest(['train: train', 'val: None', 'question: text', 'answer: answer', 'topic: lang', 'difficulty: n_chars', 'extractor: after_hash4', 'passthrough: (''source'',)']) AS line
    UNION ALL SELECT '  ' || substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END || ' -> ' || substr(a, 1, 120) || CASE WHEN length(a) > 120 THEN '…' ELSE '' END FROM (SELECT replace(text, chr(10), ' ') AS text, source || ' #### ' || n_chars AS a FROM first)""")
def config_preview(spark, folder):
    """What was decided about a data set, with its first rows shortened."""
    docs = table(spark, folder, "documents").withColumn("answer", F.concat("source", F.lit(" #### "), "n_chars"))
    flat = docs.withColumn("text", F.translate("text", "\n", " "))
    shown = infer.preview(CONFIG, flat, order="doc_id").split("\n")
    return spark.createDataFrame([(line,) for line in shown], "line string")


# Inference


@query(r"""SELECT doc_id, CASE WHEN contains(a, '####') THEN 'after_hash4' WHEN regexp_matches(a, '\\boxed\{[^}]+\}') THEN 'boxed' WHEN len(regexp_extract_all(a, '[-+]?\d*\.?\d+')) >= 5 THEN 'numeric' ELSE 'copy' END AS extractor
    FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' #### 1' WHEN 1 THEN ' \boxed{x' WHEN 2 THEN ' \boxed{x}' WHEN 3 THEN ' 1 2 3 4 .5' ELSE '' END || chr(10) || lang AS a FROM documents)""")
def guess_extractor(spark, folder):
    """What the answers of each document would be taken for: its text with a mark, and its language, as a sample of two."""
    marks = F.from_json(F.lit(json.dumps([" #### 1", " \\boxed{x", " \\boxed{x}", " 1 2 3 4 .5", ""])), "array<string>")
    answers_ = F.array(F.concat("text", F.get(marks, (F.col("doc_id") % 5).cast("int"))), F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", infer.guessed_extractor(answers_).alias("extractor"))


PARTS = ("question", "answer", "topic", "difficulty", "passthrough", "train", "val", "strategy", "ability", "extractor", "prefix")
EXTRACTOR_SQL = r"CASE WHEN contains(a, '####') THEN 'after_hash4' WHEN regexp_matches(a, '\\boxed\{[^}]+\}') THEN 'boxed' WHEN len(regexp_extract_all(a, '[-+]?\d*\.?\d+')) >= 5 THEN 'numeric' ELSE 'copy' END"


def config_sql() -> str:
    """What each data set's columns mean: which of them have values in the first five documents of each language, and what its answers look like, is looked up."""
    cases = {
        # name: answers of the first rows, and the parts that don't depend on them
        "some/Set-1": ("text || ' #### ' || n_chars", ("solution", "category", "NULL", "source", "main", "NULL", "stratified", "math", "some_set_1")),
        "plain": ("repeat('x \\boxed{' || length(lang) || '} ', 1)", ("answer", "NULL", "level", "", "train", "dev", "existing", "general", "plain")),
        "gsm8k/de": ("source || ' and ' || doc_id || ' or 1'", ("n", "NULL", "NULL", "", "only", "NULL", "random", "math", "gsm8k_de")),
        "words": ("lang", ("target", "topic", "NULL", "rationale,model", "default", "validation", "existing", "general", "words")),
    }
    out = []
    for name, (answer, (column, topic, difficulty, passed, train, val, strategy, ability, prefix)) in cases.items():
        known = {"answer": column, "topic": topic, "difficulty": difficulty, "passthrough": passed, "train": train, "val": val, "strategy": strategy, "ability": ability, "prefix": prefix}
        question = {"some/Set-1": "CASE WHEN count(text) FILTER (WHERE doc_id < 0) > 0 THEN 'question' ELSE 'problem' END", "plain": "CASE WHEN count(CASE WHEN doc_id % 2 = 1 THEN text END) > 0 THEN 'query' ELSE 'text' END", "gsm8k/de": "max('q')", "words": "CASE WHEN count(text) > 0 THEN 'input' ELSE 'text' END"}[name]
        first = "(SELECT * FROM documents ORDER BY doc_id LIMIT 5)"
        values = [f"(SELECT {question} FROM {first})", *("NULL" if known[p] == "NULL" else f"'{known[p]}'" for p in PARTS[1:9]), f"(SELECT {EXTRACTOR_SQL} FROM (SELECT string_agg({answer}, chr(10) ORDER BY doc_id) AS a FROM {first}))", f"'{prefix}'"]
        out.append(f"SELECT '{name}' AS name, unnest([{', '.join(repr(p) for p in PARTS)}]) AS part, unnest([{', '.join(values)}]) AS value")
    return " UNION ALL ".join(out)


@query(config_sql())
def infer_config(spark, folder):
    """What is inferred from four data sets made of documents: columns without values are passed over, names are taken in their order of preference, splits under other names are found."""
    docs = table(spark, folder, "documents")
    text, never = F.col("text"), F.when(F.col("doc_id") < 0, F.col("text"))
    maths = docs.select("doc_id", never.alias("question"), text.alias("problem"), F.concat("text", F.lit(" #### "), "n_chars").alias("solution"), F.col("lang").alias("category"), "source")
    boxed = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, text).alias("query"), "text", F.concat(F.lit("x \\boxed{"), F.length("lang").cast("string"), F.lit("} ")).alias("answer"), F.col("n_chars").alias("level"))
    placed = docs.select(text.alias("q"), F.concat("source", F.lit(" and "), "doc_id", F.lit(" or 1")).alias("n"), "doc_id")
    words = docs.select("doc_id", text.alias("input"), F.col("lang").alias("target"), F.col("lang").alias("topic"), F.col("source").alias("model"), F.col("source").alias("rationale"))
    sets = {"some/Set-1": {"extra": maths, "main": maths}, "plain": {"train": boxed, "dev": boxed}, "gsm8k/de": {"only": placed}, "words": {"validation": words, "default": words}}
    told = []
    for name, splits in sets.items():
        found = infer.inferred(name, splits, "doc_id")
        values = {p: getattr(found, p) for p in PARTS if p not in ("passthrough", "strategy")} | {"passthrough": ",".join(found.passthrough), "strategy": found.strategy.kind}
        told += [{"name": name, "part": p, "value": values[p]} for p in PARTS]
    return files.rows(spark, told, "name string, part string, value string")


@query(
    f"""SELECT doc_id, regexp_replace(text, '\\s+$', '') || E'\\n\\n' || '{INSTRUCTION_SQL}' AS content, {AFTER} AS ground_truth, lang AS topic, {SPLIT} AS split
    FROM (SELECT *, {RANKED.format('lang', 'doc_id')} FROM documents)"""
)
def inferred_records(spark, folder):
    """Records of a data set of a hub, whose columns are inferred from their names and first rows."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("problem"), F.concat("text", F.lit(" #### "), "n_chars", F.lit(". ")).alias("solution"), F.col("lang").alias("topic"), F.col("doc_id").alias("level"))
    root = scratch(spark, "hub")
    sinks.parquet(docs, f"{root}/some/maths-set/part/train")
    splits = hub.splits(spark, root, "some/maths-set", "part")
    made = convert.converted(splits, infer.inferred("some/maths-set", splits, "doc_id"), "doc_id")
    info = F.col("extra_info")
    return made.select(info["difficulty"].cast("bigint").alias("doc_id"), chat.first_content(F.col("prompt")).alias("content"), "reward_model.ground_truth", info["topic"].alias("topic"), info["split"].alias("split"))
