"""Draws by cutoff, numbers in the order of any key, and the order of files."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ranking, sample, split
from lodestar.plans import convert, infer


def drawn(keys, seed=2025):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("limit", [10_000, 3])
def test_draws_equal_a_full_sort(spark, monkeypatch, limit):
    """Strata of all sizes, one of a third of all rows, a null one; with cuts sent to all tasks and joined by a shuffle."""
    monkeypatch.setattr(ranking, "GROUPS_SENT", limit)
    rows = [(k, "hot" if k % 3 == 0 else None if k % 11 == 1 else f"s{k % 40}") for k in range(6000)]
    df = spark.createDataFrame(rows, "key int, stratum string").repartition(7)
    strata = defaultdict(list)
    for k, s in rows:
        strata[s].append(k)
    for ratio in (0.0, 0.02, 0.5, 1.0):
        want = {k for own in strata.values() for k in drawn(own)[: max(1, int(len(own) * ratio))]}
        found = split.stratified_split(df, "key", "stratum", ratio)
        assert found.columns == ["key", "stratum", "split"]
        assert {r.key for r in found.where("split = 'val'").collect()} == want and found.count() == len(rows)
    quotas = {"hot": 150, "s1": 4, "s2": 0, "nowhere": 3, "s4": 10**6}
    got = sample.quota_sample(df, sample.quota_table(df, quotas, "stratum"), "stratum", "key", strict=False)
    assert {r.key for r in got.collect()} == {k for s, q in quotas.items() for k in drawn(strata[s])[:q]}


def test_only_the_cut_is_ranked(spark):
    """Of 200,000 rows, the rows that meet in a window are under one in a hundred."""
    df = spark.range(200_000).withColumnRenamed("id", "key")
    shuffled = df.withColumn("digest", ranking.hash_key(1, "key"))
    found = ranking.first_rows(shuffled, "digest", "key", lambda n: F.floor(n * 0.02))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1
    assert found.where("first").count() == 4000
    bucket = found.where("first").agg(F.max(F.substring("digest", 1, 3))).first()[0]
    assert shuffled.where(F.substring("digest", 1, 3) == bucket).count() < 2000


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "key int, stratum string")
    assert split.random_split(df, "key").collect() == [] and split.stratified_split(df, "key", "stratum").collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "key int, stratum string")
    assert sorted(r.split for r in split.random_split(twice, "key").collect()) == ["train", "train", "val"]
    clash = spark.createDataFrame([(1, "x", "y", "z")], "key int, bucket string, `of` string, first string")
    assert split.random_split(clash, "key").collect() == [(1, "x", "y", "z", "val")]


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,3)", "date", "bigint"])
def test_numbers_in_the_order_of_any_key(spark, kind):
    key = {"date": F.expr("date_add(date'1990-01-01', cast(id * 7919 % 9000 as int))"), "string": F.concat(F.lit("é"), (F.col("id") * 7919 % 9000).cast("string"))}.get(kind, (F.col("id") * 7919 % 9000).cast(kind))
    df = spark.range(9000).select(key.alias("k")).unionByName(spark.sql(f"SELECT cast(NULL AS {kind}) AS k")).repartition(5)
    found = split.generated_ids(df, "k", "row").collect()
    assert [r.k for r in sorted(found, key=lambda r: r.id)] == [r.k for r in df.orderBy("k").collect()]
    assert len({r.id for r in found}) == 9001 and max(r.id for r in found) == "row-009000"


def test_source_order_of_parquet_and_text(spark, tmp_path):
    for k in (0, 1, 2):
        spark.range(k * 100, k * 100 + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p/part={k}"))
    df = spark.read.parquet(str(tmp_path / "p"))
    placed = ranking.in_order(df).where("id % 3 <> 0")
    ids = sorted((r.id, r.name) for r in split.generated_ids(placed.select(F.col("id").alias("name"), "source_order"), "source_order", "x").collect())
    assert [n for _, n in ids] == [k for k in range(300) if k % 3] and ids[0][0] == "x-000000"
    (tmp_path / "t").mkdir()
    for k in (0, 1):
        (tmp_path / f"t/{k}.csv").write_text("q,a\n" + "".join(f"w{k}-{i},y\n" for i in range(50)))
    lines = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert not ranking.has_row_index(lines) and ranking.has_row_index(df)
    rows = split.generated_ids(ranking.in_order(lines), "source_order", "x").collect()
    assert [r.q for r in sorted(rows, key=lambda r: r.id)] == [f"w{k}-{i}" for k in (0, 1) for i in range(50)]


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_records_without_a_key(spark, tmp_path, form):
    """Split, and numbered in the order of the file."""
    df = spark.createDataFrame([(f"q{k}", f"{k}") for k in range(120)], "question string, answer string").coalesce(1)
    df.write.option("header", True).format(form).save(str(tmp_path / "d"))
    table = spark.read.option("header", True).format(form).load(str(tmp_path / "d"))
    made = convert.converted({"train": table}, infer.Config("d", "question", "answer")).collect()
    numbers = {name: [int(r["reward_model"]["ground_truth"]) for r in sorted(made, key=lambda r: r["extra_info"]["index"]) if r["extra_info"]["split"] == name] for name in ("train", "val")}
    assert len(numbers["val"]) == 2 and len(numbers["train"]) == 118 and all(n == sorted(n) for n in numbers.values())
    held = convert.converted({"train": table, "val": table.limit(5)}, infer.Config("d", "question", "answer", val="val")) if form == "csv" else None
    assert held is None or held.count() == 125
