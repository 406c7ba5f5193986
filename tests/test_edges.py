"""Edge rows of the operators, as the fixtures list them."""

import pytest
from pyspark.sql import functions as F

from lodestar import queries
from lodestar.functions import answers, chat, statistics, text
from lodestar.operators import cluster, enrich, jsonkeys, judge, profile, sample, split, validate


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string").orderBy("k").select(expression).collect()]


def test_after_hashes(spark):
    rows = ["w #### 1\n2 ", "abc ####", "#####5", "a #### 1 #### 2", "#### \n", None]
    assert values(spark, rows, answers.after_hashes(F.col("v"))) == ["1 2", "abc ####", "#5", "1 #### 2", "", None]


def test_boxed(spark):
    rows = [r"\boxed{7} \boxed{8}", r"\boxed{\frac{1}{2}}", r"\boxed{}"]
    assert values(spark, rows, answers.boxed(F.col("v"))) == ["7", r"\frac{1", r"\boxed{}"]


def test_numeric(spark):
    rows = ["3/4", "1,234", "5-3", "1.5.2", "x=-.5", "none", None]
    assert values(spark, rows, answers.numeric(F.col("v"))) == ["4", "234", "-3", ".2", "-.5", "none", None]


def test_by_pattern(spark):
    assert values(spark, ["a<x\ny>", "none.", "<>"], answers.by_pattern(F.col("v"), "<(.*)>")) == ["x y", "none", ""]
    for wrong in (None, "(?P<n>x)"):
        with pytest.raises(ValueError):
            answers.by_pattern(F.col("v"), wrong)


def test_unknown_extractor_copies(spark):
    assert values(spark, [" a  b. "], answers.extracted(F.col("v"), "other")) == ["a b"]


def test_norm_spaces(spark):
    rows = ["  a  b\n c. ", "3.", "a..", "abc .", "a　 b\x1f"]
    assert values(spark, rows, text.norm_spaces(F.col("v"))) == ["a b c", "3", "a.", "abc ", "a b"]


def test_strips(spark):
    assert values(spark, ["　q\t\n"], text.strip(F.col("v"))) == ["q"]
    assert values(spark, [" q 　"], text.rstrip(F.col("v"))) == [" q"]


def test_names(spark):
    rows = ["metrics_-_accuracy", "bio/med", "unnamed:_31"]
    assert values(spark, rows, text.column_name(F.col("v"))) == ["metrics_accuracy", "bio_med", "unnamed_31"]
    assert text.slug("Open-R1/Math") == "open_r1_math"
    assert text.normalised_columns(spark.createDataFrame([(1, 2)], "`a b` int, `c:` int")).columns == ["a_b", "c"]
    with pytest.raises(ValueError):
        text.normalised_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_stems_and_cuts(spark):
    assert values(spark, ["/x/a.b.csv", "/x/.hidden", "plain"], text.stem(F.col("v"))) == ["a.b", ".hidden", "plain"]
    assert values(spark, ["x" * 121, None], text.truncate(F.col("v"))) == ["x" * 120 + "…", ""]
    assert values(spark, ["NA", "x", None], text.null_if_na(F.col("v"))) == [None, "x", None]


def test_thoughts(spark):
    assert values(spark, [None, " t "], chat.thought(F.col("v"))) == ["", "t"]
    assert values(spark, [None], chat.thought(F.col("v"), nan_text=True)) == ["nan"]


def test_template_is_filled_once(spark):
    filled = chat.filled("{question}\n{instruction}{{}}", question=F.col("v"), instruction="i")
    assert values(spark, ["{instruction}"], filled) == ["{instruction}\ni{}"]
    prompt = chat.user_prompt("{question}|{instruction}", F.col("v"), "i", strict_nulls=False)
    assert values(spark, ["q  ", None], chat.first_content(prompt)) == ["q|i", "None|i"]


@pytest.mark.parametrize("rows, ratio, size", [(1, 0.02, 1), (49, 0.02, 1), (100, 0.02, 2), (100, 0.29, 28), (0, 0.02, 0)])
def test_split_sizes(spark, rows, ratio, size):
    made = split.random_split(spark.range(rows), "id", ratio)
    assert made.count() == rows and made.where("split = 'val'").count() == size


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    one = {tuple(r) for r in split.stratified_split(df, "id", "s").select("id", "split").collect()}
    assert one == {tuple(r) for r in split.stratified_split(df.repartition(13), "id", "s").select("id", "split").collect()}


def test_null_stratum_and_single_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, s string")
    found = {r["id"]: r["split"] for r in split.stratified_split(df, "id", "s").collect()}
    assert found[3] == "val" and sorted((found[1], found[2])) == ["train", "val"]


def test_split_needs_a_train_table():
    with pytest.raises(ValueError):
        split.split(None, None, "id", split.Strategy())


def test_half_even_quotas(spark):
    df = spark.createDataFrame([(c,) for c in "a" * 5 + "b" * 7 + "c" * 1 + "d" * 187], "c string")
    found = {r["c"]: r["quota"] for r in sample.allocation(df, "c", 100).collect()}
    assert (found["a"], found["b"], found["c"]) == (2, 4, 0)
    with_null = sample.allocation(spark.createDataFrame([("a",), (None,)], "c string"), "c", 10).collect()
    assert [(r["c"], r["share"], r["quota"]) for r in with_null] == [("a", 0.5, 5)]


def test_quota_above_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id int, c string")
    quotas = sample.quota_table(df, {"a": 3, "z": 1}, "c")
    with pytest.raises(ValueError):
        sample.quota_sample(df, quotas, "c", "id")
    assert sample.quota_sample(df, quotas, "c", "id", strict=False).count() == 2
    assert [r["c"] for r in sample.missing_categories(quotas, df, "c").collect()] == ["z"]
    assert sum(sample.QUOTA.values()) == 500
    with pytest.raises(ValueError):
        sample.dropped(df, "nothing")


def test_null_keys_in_joins(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert enrich.enriched(df, df, "k").count() == 1
    both = enrich.enriched(df, df, "k", null_keys_match=True)
    assert both.count() == 2 and both.columns == ["k", "v_x", "v_y"]
    with pytest.raises(TypeError):
        enrich.enriched(df, df.withColumn("k", F.col("k").cast("string")), "k")


def test_judge_shapes(spark):
    rows = ['{"a":{"judge_response":null}}', '[{"id":"x","judge_response":null}]', '[{"id":"x"}]', '{"a":5}', "[3]", "broken", '[{"b":{"judge_response":{"correct":true,"confidence":1.5}}}]', '{"c":{"judge_response":{"correct_answer":"1"},"x":1}}', '[{"id":"d","judge_response":{"correct":false}}]', None]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    found = sorted(tuple(r) for r in judge.flattened(df, title_case=True).collect())
    assert found == [("a", "", "", ""), ("b", "", "True", "1.5"), ("c", "1", "", ""), ("d", "", "False", "")]


def test_json_keys(spark):
    assert values(spark, ['{"b":1,"a":2}', "[1]", "bad{", "", None], jsonkeys.keys(F.col("v"))) == [["b", "a"], [], [], [], []]
    with pytest.raises(ValueError):
        jsonkeys.padded(spark.createDataFrame([], "f string, keys array<string>"), "keys")


def test_nodes(spark):
    df = spark.createDataFrame([("n[84-86,9]",), ("n84",), ("n[3-1]",)], "nodes string")
    assert [(r["node"], r["node_rank"]) for r in cluster.expanded_nodes(df, "nodes").collect()] == [("n84", 0), ("n85", 1), ("n86", 2), ("n09", 3)]
    assert cluster.valid_nodes(["g1"], ["g1", "g2"], "osk-") == ["osk-g1"]
    with pytest.raises(ValueError):
        cluster.valid_nodes(["g1 g2"], ["g1", "g2"])


def test_accelerators(spark):
    df = spark.createDataFrame([("a", "gpu:X:8", "gpu:X:3(IDX:0-2)"), ("b", "gpu:X:8", "gpu:X:0"), ("c", "gpu:X:8", "gpu:X:8"), ("d", "(null)", "x"), ("e", "gpu:X:8(S:0-1)", "gpu:X:0")], "NODE string, GRES string, GRES_USED string")
    found = {r["NODE"]: (r["TOTAL"], r["FREE"], r["STATE"]) for r in cluster.accelerators(df).collect()}
    assert found == {"a": (8, 5, "mix"), "b": (8, 8, "idle"), "c": (8, 0, "alloc"), "d": (0, 0, "idle"), "e": (8, 8, "mix")}


def test_intervals(spark):
    assert statistics.t_quantile(4) == pytest.approx(2.7764451, abs=1e-6) and statistics.t_quantile(2) == pytest.approx(4.3026527, abs=1e-6)
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 5)] + [("h", 1.0)], "run string, score double")
    found = {r["run"]: (r["mean"], r["low"], r["high"]) for r in profile.mean_interval(df, "run", "score").collect()}
    assert found == {"g": (3.0, 1.04, 4.96), "h": (1.0, None, None)}
    beyond = spark.range(1).select(statistics.t975(F.lit(201))).first()[0]
    assert beyond == pytest.approx(statistics.t_quantile(201), abs=1e-7)


def test_records_are_validated(spark):
    with pytest.raises(ValueError):
        validate.violations(spark.range(1))
    assert validate.renamed_id(spark.createDataFrame([(1,)], "ID int")).columns == ["id"]
    with pytest.raises(ValueError):
        validate.require_columns(spark.createDataFrame([(1,)], "question int"), ["Question"])


def test_numeric_share(spark):
    df = spark.createDataFrame([("1",), (" 2/3 ",), ("x",), (None,)], "v string")
    assert profile.numeric_share(df, F.col("v")).first()[0] == pytest.approx(2 / 3)


def test_membership_keeps_every_row(spark):
    df = spark.createDataFrame([(k, ["a", "b", None][k % 5 % 3]) for k in range(500)] + [(None, "a"), (7, None)], "id long, kind string")
    found = sample.membership(df, "kind", "id").collect()
    assert sorted((str(r["id"]), str(r["kind"])) for r in found) == sorted((str(r["id"]), str(r["kind"])) for r in df.collect())
    for kind in ("a", "b", None):
        own = sorted(r["place"] for r in found if r["kind"] == kind)
        assert own == list(range(len(own))) and own


def test_membership_query_covers_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.QUERIES["category_membership"](spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_names_that_operators_use_may_clash(spark):
    names = ("bucket", "of", "start", "rows", "place", "count", "digest", "stratum", "drawn", "all", "quota", "_key", "kind_of")
    df = spark.createDataFrame([(k, "ab"[k % 2], *names) for k in range(40)], "id long, kind string, " + ", ".join(f"`{n}` string" for n in names))
    quotas = sample.quota_table(df, {"a": 3, "b": 4}, "kind")
    for made, rows in ((split.stratified_split(df, "id", "kind"), 40), (split.random_split(df, "id"), 40), (split.generated_ids(df, "id", "x", "made"), 40), (sample.quota_sample(df, quotas, "kind", "id"), 7)):
        found = made.collect()
        assert len(found) == rows and all(r[n] == n for r in found for n in names)
    assert len(enrich.enriched(df, df.select("id", "_key", "of"), "id").columns) == len(df.columns) + 2


def test_keys_of_many_rows_on_both_sides_are_dealt_to_many_tasks(spark, monkeypatch):
    from collections import Counter

    from lodestar.operators import enrich

    monkeypatch.setattr(enrich, "TASK_PAIRS", 1000)
    key = F.when(F.col("id") % 3 > 0, F.col("id") % 3)
    left, right = spark.range(300).select(key.alias("k"), F.col("id").alias("v")), spark.range(90).coalesce(1).select(key.alias("k"), F.col("id").alias("v"), "id")
    plain = [enrich.enriched(left.coalesce(1), right, "k", null_keys_match=n) for n in (False, True)]
    many = [enrich.enriched(left.coalesce(1), right, "k", null_keys_match=n, many=True) for n in (False, True)]
    for a, b in zip(plain, many, strict=True):
        assert a.schema == b.schema and Counter(a.collect()) == Counter(b.collect())
    assert many[1].count() == 9000
    assert many[1].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 4000


def _dealt(plan):
    """Rows that the repartitions of an executed plan have written."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _dealt(plan.executedPlan())
    if "QueryStage" in name:
        return _dealt(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" and "REPARTITION" in plan.toString().split("\n")[0] else 0
    return own + sum(_dealt(plan.children().apply(k)) for k in range(plan.children().size()))


def test_rows_of_many_pairs_are_copied_a_few_times_only(spark, monkeypatch):
    """What is shuffled grows with the rows of a key, not with its pairs."""
    from lodestar.operators import enrich

    monkeypatch.setattr(enrich, "TASK_PAIRS", 20)
    for n, m in ((600, 40), (40, 600), (200, 200)):
        left, right = spark.range(n).selectExpr("1 AS k", "id AS v"), spark.range(m).selectExpr("1 AS k", "id AS w")
        made = enrich.enriched(left, right, "k", many=True)
        found = made.collect()
        assert len(found) == n * m == len(set(found))
        dealt = _dealt(made._jdf.queryExecution().executedPlan())
        assert 0 < dealt <= 1.5 * enrich.COPIES * (n + m)
    monkeypatch.setattr(enrich, "HELD_ROWS", 60)
    made = enrich.enriched(left, right, "k", many=True)
    assert len(set(made.collect())) == 40_000 and made.groupBy(F.spark_partition_id()).count().count() >= 4


def test_prompts_are_answered_in_slices(monkeypatch):
    import pyarrow as pa

    from lodestar.operators import annotate

    monkeypatch.setattr(annotate, "SLICE_BYTES", 10)
    parts = list(annotate.slices(pa.array(["abcd", None, "efgh", "x" * 30, "y" * 10, "z"])))
    assert parts == [["abcd", None, "efgh"], ["x" * 30], ["y" * 10], ["z"]]
    assert list(annotate.slices(pa.array([], pa.string()))) == []
