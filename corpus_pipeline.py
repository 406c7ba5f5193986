"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

What holds for all stages: null, empty and very long texts, null and repeated doc_ids, repeated rows and empty tables are allowed; columns besides those of
`documents` are left out, so their names can't clash; an empty table gives an empty one. Rows equal in all columns get equal decisions, except that one of a
group of near duplicates stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, linededup, ngram, queries, toxicity
from lodestar.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled ones outside the held-out fifth, calls toxic.

    Null and empty texts are scored like a text without letters, and stay unless nearly all labelled documents are toxic. Equal texts stay or go together.
    """
    scored = toxicity.score(docs.select(*COLUMNS), queries.toxicity_model(spark, folder), score="_score", predicted="_toxic")
    return scored.where("_toxic = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without later copies of line runs; documents of which no word is left go, others get their new length.

    Null and empty texts stay as they are. Which copy is later follows doc_id (null first), then the text's digest, then the place in it.
    Rows equal in doc_id and text are one document, and all of them stay or lose the same lines.
    """
    cut = linededup.dedup(docs.select(*COLUMNS), deleted="_deleted").where(F.expr("_deleted = 0 or regexp_like(text, '[^\\\\x20\\\\x09-\\\\x0D]')"))
    return cut.withColumn("n_chars", F.when(F.col("_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (null last), of equal ones that of the smallest text digest.

    Rows are judged one by one: of two rows of one doc_id, only that goes whose text is near another's. Of rows equal in doc_id and text, one stays, with
    the smallest lang, source and n_chars. Texts without words (null, empty) are near nothing: all their rows stay.
    """
    keyed = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")).alias("row"))
    found = stored(ngram.near_duplicates(keyed, key="row").where("n_shingles > 0"), "near-duplicates")
    later = found.where("component_id <> row").select("row").distinct()
    repeated = found.where("component_id = row").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    alone = keyed.join(later.unionByName(repeated), "row", "left_anti").select(*COLUMNS)
    one = keyed.join(repeated, "row", "left_semi").groupBy("row").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("kept"))
    return alone.unionByName(one.select("row.doc_id", "kept.text", "kept.lang", "kept.source", "kept.n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled globally.

    A null source is a source of its own. Rows of one doc_id and source get equal counts, which may be 0; texts play no part.
    """
    return queries.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every row, checked by decoding: doc_id, number of tokens, the ids and the digest of the decoded bytes.

    Null and empty texts have no ids. Every row gives one, equal texts equal ids.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
#: SQL expresses neither the classifier nor the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
