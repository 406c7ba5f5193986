"""Row-wise annotation by a language-model service: prompts in, replies out, in batches that Spark deals out."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import unused
from .scratch import scratch


#: Bytes of prompts that are taken from a batch together.
SLICE_BYTES = 4 << 20


class Client(Protocol):
    def __call__(self, prompt: str, system: str) -> str: ...


class Stub:
    """Answers without a network: the start of the prompt's MD5."""

    def __call__(self, prompt: str, system: str) -> str:
        return "reply:" + hashlib.md5(prompt.encode()).hexdigest()[:8]


@dataclass(frozen=True)
class Http:
    """Posts a form and takes `Text` of the JSON reply, empty if it isn't there. Certificates are checked; failures are tried again."""

    url: str
    session: str = ""
    timeout: float = 60.0
    tries: int = 3

    def __call__(self, prompt: str, system: str) -> str:
        form = urllib.parse.urlencode({"sessionId": self.session, "userPromptText": prompt, "systemPromptText": system}).encode()
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(self.url, form, timeout=self.timeout) as reply:
                    return json.load(reply).get("Text", "")
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(2**attempt)
        return ""


def slices(prompts: pa.Array) -> Iterator[list[str | None]]:
    """Neighbouring prompts of about SLICE_BYTES bytes; a longer one is alone."""
    start = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(prompts), 0).to_pylist()):
        if k > start and held + n > SLICE_BYTES:
            yield prompts.slice(start, k - start).to_pylist()
            start, held = k, 0
        held += n
    if start < len(prompts):
        yield prompts.slice(start).to_pylist()


def annotate(df: DataFrame, prompt: Column, name: str, client: Callable[[], Client] = Stub, system: str = "", at_once: int = 4, partitions: int | None = None) -> DataFrame:
    """Adds the reply to each row's prompt; a null prompt has none. `client` is called once in each task, which sends `at_once` prompts at a time."""

    def replies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = client()
        with ThreadPoolExecutor(at_once) as pool:
            for prompts in batches:
                # a slice at a time, so that a worker holds few texts besides the batch
                yield pa.array([reply for part in slices(prompts) for reply in pool.map(lambda p: None if p is None else ask(p, system), part)], pa.string())

    replies.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    spread = df if partitions is None else df.repartition(partitions)
    return spread.withColumn(name, F.arrow_udf(replies, "string")(prompt))


REPLIES = "prompt_digest string, reply string"


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_digest, reply) of all prompts asked so far; no rows where nothing was stored yet."""
    try:
        return spark.read.schema(REPLIES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], REPLIES)


def annotate_once(df: DataFrame, prompt: Column, name: str, path: str, client: Callable[[], Client] = Stub, system: str = "", at_once: int = 4, partitions: int | None = None, block: int = 10_000) -> DataFrame:
    """Adds the reply to each row's prompt, of which every distinct one is asked once, also over many runs; a null prompt has no reply.

    Replies are kept in Parquet at `path`, by the digest of system and prompt. Prompts that aren't there yet are asked in blocks of about `block`, each stored
    when it is answered: after a failure, a new run asks only what is left, at most a block twice. Prompts of equal rows, and of rows that come later, cost nothing.
    """
    spark = df.sparkSession
    digest, asked = unused([*df.columns, name], "prompt_digest", "prompt")
    keyed = df.withColumn(asked, prompt).withColumn(digest, F.when(F.col(asked).isNotNull(), F.sha2(F.concat_ws("\0", F.lit(system), F.col(asked)), 256)))
    known = stored_replies(spark, path).select(F.col("prompt_digest").alias(digest))
    distinct = keyed.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.first(asked).alias(asked)).join(known, digest, "left_anti")
    left = scratch(spark, "prompts")
    distinct.write.parquet(left)
    waiting = spark.read.schema(distinct.schema).parquet(left)
    blocks = -(-waiting.count() // block)
    for k in range(blocks):
        part = waiting.where(F.pmod(F.xxhash64(digest), F.lit(blocks)) == k)
        replies = annotate(part, F.col(asked), "reply", client, system, at_once, partitions)
        replies.select(F.col(digest).alias("prompt_digest"), "reply").write.mode("append").parquet(path)
    told = stored_replies(spark, path).select(F.col("prompt_digest").alias(digest), F.col("reply").alias(name)).dropDuplicates([digest])
    return keyed.drop(asked, name).join(told, digest, "left").drop(digest)
