"""The three ways from source tables to training records, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.answers import extracted
from lodestar.functions.chat import messages, question_answer, user_prompt
from lodestar.operators import sample
from lodestar.operators.names import unused
from lodestar.operators.ranking import fixed_order
from lodestar.operators.split import generated_ids, indexed, split
from lodestar.operators.validate import complete, id_first, renamed_id, require_columns

from .infer import Config


def extra_info(df: DataFrame, config: Config) -> Column:
    """split and index, then what the table has of topic, difficulty (a number, and the text as it was) and passed-through columns."""
    parts = [F.col("split"), F.col("index").cast("bigint").alias("index")]
    if config.topic in df.columns:
        parts.append(F.col(config.topic).alias("topic"))
    if config.difficulty in df.columns:
        parts += [F.col(config.difficulty).try_cast("double").alias("difficulty"), F.col(config.difficulty).cast("string").alias("difficulty_text")]
    parts += [F.col(c) for c in config.passthrough if c in df.columns]
    return F.struct(*parts)


def unified(df: DataFrame, config: Config, strict_nulls: bool = True) -> DataFrame:
    """Unified records from a table with split and index."""
    require_columns(df, (config.question, config.answer, "split", "index"))
    return df.select(
        F.lit(config.data_source).alias("data_source"),
        user_prompt(config.template, F.col(config.question), config.instruction, strict_nulls).alias("prompt"),
        F.lit(config.ability).alias("ability"),
        F.struct(F.lit(config.style).alias("style"), extracted(F.col(config.answer), config.extractor, config.pattern).alias("ground_truth")).alias("reward_model"),
        extra_info(df, config).alias("extra_info"),
    )


def converted(splits: dict[str, DataFrame], config: Config, key: str | None = None) -> DataFrame:
    """Splits, row numbers and records. `key` is the rows' source order, unique in each table and never null: a number or a text. Without one, the order of the files' rows is taken.

    Rows are split and numbered by key and stratum alone, and joined with the rest once, so that long columns are shuffled once at most.
    """
    train, val = splits.get(config.train), splits.get(config.val) if config.val else None
    if key is None:
        key, = unused([c for t in (train, val) if t is not None for c in t.columns], "source_order")
        train, val = (None if t is None else fixed_order(t, key) for t in (train, val))
    slim = [key] + [c for c in {config.strategy.by} - {None, key} if val is None]
    bare = [None if t is None else t.select(*slim) for t in (train, val)]
    placed = split(*bare, key, config.strategy, config.seed)
    source = bare[0].select(key) if val is None else bare[0].select(key).unionByName(bare[1].select(key))
    placed = indexed(placed, key, source=source).select(key, "split", "index")
    if val is None:
        return unified(train.drop("split", "index").join(placed, key), config)
    rows = [t.drop("split", "index").withColumn("split", F.lit(name)) for name, t in (("train", train), ("val", val))]
    return unified(rows[0].unionByName(rows[1]).join(placed, [key, "split"]), config)


def chat_table(df: DataFrame, system: str = "", tags: bool = True, nan_text: bool = False, source_index: str | None = None, stem: str = "row") -> DataFrame:
    """[id], messages from Question, Answer, [Think], [ID]. Without an ID, `source_index` makes ids from its order. Rows without question or answer go."""
    return _formatted(df, "messages", lambda think: messages(F.col("Question"), F.col("Answer"), think, system, tags, nan_text), source_index, stem)


def question_table(df: DataFrame, tags: bool = True, source_index: str | None = None, stem: str = "row") -> DataFrame:
    """[id], extra_info with question and answer, from the same columns."""
    return _formatted(df, "extra_info", lambda think: question_answer(F.col("Question"), F.col("Answer"), think, tags), source_index, stem)


def _formatted(df, name, build, source_index, stem):
    require_columns(df, ("Question", "Answer"))
    kept = renamed_id(complete(df, "Question", "Answer"))
    if source_index and "id" not in kept.columns:
        kept = generated_ids(kept, source_index, stem)
    return id_first(kept.withColumn(name, build(F.col("Think") if "Think" in df.columns else None)), name)


def proportional_sample(source: DataFrame, by: str, key: str, size: int = 500, keep: Column | None = None, drop: tuple[str, ...] = (), seed: int = 2025) -> DataFrame:
    """Whole rows of a sample in proportion to the categories of the rows in `keep`, by quotas that need not sum to `size`."""
    eligible = source if keep is None else source.where(keep)
    quotas = sample.allocation(eligible, by, size).select(by, "quota")
    chosen = sample.quota_sample(eligible.select(by, key), quotas, by, key, seed, strict=False)
    return sample.dropped(sample.full_rows(source, chosen, key), *drop)
