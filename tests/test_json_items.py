import json
import random

from pyspark.sql import functions as F

from lodestar.operators import judge
from lodestar.sources import json_items


def parts(spark, path):
    return spark_rows(json_items.items(spark, str(path)))


def spark_rows(df):
    return [(r.keyed, r.value) for r in df.orderBy("path", "place").collect()]


def write(tmp_path, name, value, **how):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, **how), encoding="utf-8")
    return path


def nested(r, depth=0):
    kind = r.choice("ssnlo" if depth < 3 else "sn")
    if kind == "s":
        return "".join(r.choice('ab{}[]",\\:é漢\n ') for _ in range(r.randint(0, 9)))
    if kind == "n":
        return r.choice([1, -2.5, True, False, None])
    if kind == "l":
        return [nested(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {f"k{i}": nested(r, depth + 1) for i in range(r.randint(0, 3))}


def test_items_of_arrays_and_objects_in_tiny_splits(spark, tmp_path):
    """Whatever the splits, the parts joined in order are the file."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for seed in range(4):
                r = random.Random(seed)
                array = [nested(r) for _ in range(40)]
                found = parts(spark, write(tmp_path, f"a{seed}{size}.json", array, indent=[None, 1, None, 3][seed]))
                assert not any(k for k, _ in found) and [x for _, v in found for x in json.loads(v)] == array
                objects = {f"id{i}": {"v": nested(r), "}{": 'x"}'} for i in range(30)}
                found = parts(spark, write(tmp_path, f"o{seed}{size}.json", objects, indent=[2, None, None, 1][seed]))
                assert all(k for k, _ in found) and {a: b for _, v in found for a, b in json.loads(v).items()} == objects
                assert len(found) >= 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges(spark, tmp_path):
    for k, (text, want) in enumerate([("[]", ["[]"]), ("{}", ["{}"]), (" \n", []), ("", []), ("[1, 2]", ["[1, 2]"]), ('"text"', ['"text"']), ('﻿[{"a": 1}, 3]\n', ['[{"a": 1}]', "[3]"]), ('{"a": {"b": 1}, "c": 5}', ['{"a": {"b": 1}}', '{"c": 5}'])]):
        assert [v for _, v in parts(spark, write(tmp_path, f"{k}.json", text))] == want, text


def test_verdicts_of_items_are_those_of_whole_files(spark, tmp_path):
    r = random.Random(5)
    answer = lambda i: {"judge_response": {"correct": r.choice(["yes", True, None]), "confidence": i, "correct_answer": '}"{'}}
    files = {"one": {f"id{i % 25}": answer(i) for i in range(40)}, "two": [{f"x{i}": answer(i)} for i in range(9)] + [4, {"id": "y", **answer(3)}, {"a": 1, "b": 2}], "three": {"n": {"judge_response": None}, "m": 3}}
    texts = {n: json.dumps(v) for n, v in files.items()}
    texts["four"] = '{"a": {"judge_response": {"correct": "first"}}, "b": {"judge_response": {"correct": "b"}}, "a": {"judge_response": {"correct": "last", "correct": "very last"}}}'
    for n, t in texts.items():
        write(tmp_path, f"{n}.json", t)
    whole = judge.flattened(spark.createDataFrame([(t,) for t in texts.values()], "value string"))
    cut = judge.flattened_items(json_items.items(spark, f"{tmp_path}/*.json"))
    key = lambda rows: sorted(tuple(x) for x in rows)
    assert key(cut.drop("path").collect()) == key(whole.collect())
    assert ("a", "", "very last", "") in key(whole.collect())


def test_a_file_is_many_rows_of_many_tasks(spark, tmp_path):
    path = write(tmp_path, "big.json", [{"id": i, "text": "x" * 200} for i in range(20_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        pieces = json_items._pieces(spark, str(path))
        assert pieces.select("block").distinct().count() > 10
        found = json_items.items(spark, str(path)).agg(F.count("*"), F.max(F.length("value"))).first()
        assert found[0] == 20_000 and found[1] < 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
