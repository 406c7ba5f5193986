"""Verdicts of a judge, in any of three JSON shapes, as flat rows."""

from __future__ import annotations

import json as json_text
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused

FIELDS = ("correct_answer", "correct", "confidence")


def _last_keys(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON texts with repeated keys, of which the last counts, written without; null for what isn't JSON. Infinite and undefined numbers become null."""

    def once(text):
        try:
            return None if text is None else json_text.dumps(json_text.loads(text, parse_constant=lambda _: None), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    for texts in documents:
        yield pd.Series([once(t) for t in texts], dtype=object)


_last_keys.__annotations__ = {"documents": Iterator[pd.Series], "return": Iterator[pd.Series]}


def parsed_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the JSON value of a text as a variant, null for what isn't JSON. Of a key that is there twice, the last counts, whatever the session says.

    Spark's own parser refuses repeated keys by default; only texts that it refuses go to a parser of their own, in Arrow batches.
    """
    plain, refused = unused([*df.columns, name], "plain", "refused")
    tried = df.withColumn(plain, F.try_parse_json(F.col(text)))
    again = tried.withColumn(refused, F.pandas_udf(_last_keys, "string")(F.when(F.col(plain).isNull(), F.col(text))))
    return again.withColumn(name, F.coalesce(F.col(plain), F.try_parse_json(F.col(refused)))).drop(plain, refused)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")


def _field(response: Column, name: str, title_case: bool) -> Column:
    text = F.coalesce(F.try_variant_get(response, f"$.{name}", "string"), F.lit(""))
    return F.when(text == "true", "True").when(text == "false", "False").otherwise(text) if title_case else text


def flattened(df: DataFrame, json: str = "value", keep: tuple[str, ...] = (), title_case: bool = False) -> DataFrame:
    """(id, correct_answer, correct, confidence), all text, from documents with one JSON value each.

    Shapes: an object {id: {"judge_response": {...}}}; a list of such objects with one key; a list of {"id": ..., "judge_response": {...}}.
    Values that aren't objects give no row. A null response of the keyed shapes gives a row of empty texts, one of the third
    shape none. Missing and null fields are empty. Booleans read true and false, or with title_case True and False. Documents that aren't JSON give no
    rows. Columns in `keep` go along. Of keys that are there twice in an object, the last counts.

    A document is parsed once: each shape becomes a list of items, an item a list of (id, value), which are taken apart together.
    """
    doc, item, kept = F.col("doc"), F.col("item"), F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keep]).alias("kept")
    parsed = parsed_json(df.select(kept, F.col(json).alias("text")), "text", "doc").where("doc is not null")
    listed = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
    items = parsed.select("kept", F.schema_of_variant(doc).startswith("OBJECT").alias("keyed"), F.explode(listed).alias("item")).where(_is_object(item))
    members = F.map_entries(F.try_variant_get(item, "$", "map<string,variant>"))
    plain = F.filter(F.array(F.struct(F.try_variant_get(item, "$.id", "string").alias("key"), item.alias("value"))), lambda e: e["key"].isNotNull() & _is_object(F.try_variant_get(e["value"], "$.judge_response", "variant")))
    entries = items.select("kept", F.explode(F.when(F.col("keyed") | (F.size(members) == 1), members).otherwise(plain)).alias("e")).where(_is_object(F.col("e.value")))
    response = entries.select("kept", F.col("e.key").alias("id"), F.try_variant_get("e.value", "$.judge_response", "variant").alias("response"))
    return response.select(*[F.col(f"kept.`{k}`") for k in keep], "id", *[_field(F.col("response"), name, title_case).alias(name) for name in FIELDS])


def flattened_items(items: DataFrame, title_case: bool = False) -> DataFrame:
    """(path, id, correct_answer, correct, confidence) of the items of large documents: (path, keyed, place, value), as sources.json_items gives them.

    The rows are those of `flattened` for the whole documents: of an id that is there twice among the members of an object, the last counts.
    """
    rows = flattened(items, "value", ("path", "keyed", "place"), title_case)
    last = rows.where("keyed").groupBy("path", "id").agg(F.max_by(F.struct(*FIELDS), "place").alias("last"))
    return rows.where("not keyed").select("path", "id", *FIELDS).unionByName(last.select("path", "id", "last.*"))
