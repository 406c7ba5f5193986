"""Charsets, first lines, the hub source, streams that resume, annotation that resumes, quarantine."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import annotate, judge, validate
from lodestar.plans import infer
from lodestar.sources import charsets, files, hub, sinks
from lodestar.streaming import records


def test_headers_that_differ_by_a_letters_case_as_bytes(spark, tmp_path):
    """As bytes, ア and ヂ end in A and a; ソ and 能 in a backslash."""
    (tmp_path / "a.csv").write_bytes('ア,ヂ,ソ,ア,\n1,"能\n,""表""",ｱﾂ,～,x\n'.encode("cp932"))
    (tmp_path / "b.csv").write_bytes("ア,ヂ,ソ,ア,\n2,,,,\n".encode("cp932"))
    table = files.csv(spark, str(tmp_path), "cp932")
    assert table.columns == ["ア", "ヂ", "ソ", "ア3", "_c4"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", '能\n,"表"', "ｱﾂ", "～", "x"), ("2", None, None, None, None)]


@pytest.mark.parametrize("encoding, text", [("shift_jis", "漢字ソ"), ("euc_jp", "漢字"), ("gbk", "汉字"), ("big5", "漢字"), ("euc_kr", "한글"), ("cp1252", "naïve €"), ("latin-1", "é\x85\xa0"), ("windows-1251", "слово"), ("utf-16", "é漢"), ("Windows-31J", "髙①")])
def test_round_trips(spark, tmp_path, encoding, text):
    df = spark.createDataFrame([(text, None), ('a"b,\n' + text, " x ")], "a string, b string")
    back = files.csv(spark, sinks.csv(df, str(tmp_path / "out"), encoding=encoding), encoding)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_cells_of_another_charset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\nx,\x81\nok,y\n")
    with pytest.raises(Exception, match="UnicodeDecodeError|illegal multibyte|incomplete multibyte"):
        files.csv(spark, str(tmp_path / "a.csv"), "cp932").collect()
    assert [r.b for r in files.csv(spark, str(tmp_path / "a.csv"), "cp932", errors="replace").collect()] == ["�", "y"]
    with pytest.raises(ValueError, match="unknown charset"):
        charsets.codec("iso-2022-jp")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "none.csv").write_bytes(b"")
    assert files.csv(spark, str(tmp_path / "e"), "cp932").columns == []


def test_judge_of_repeated_keys_in_any_session(spark):
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"
    docs = ['{"a": {"judge_response": {"correct": "x", "correct": "y"}}}', '{"a": {"judge_response": {"correct": "1"}}, "a": {"judge_response": {"correct": "2"}}}', '{"b": {"judge_response": {"correct": NaN}}}', "{bad", None, "[" * 5000]
    found = judge.flattened(spark.createDataFrame([(d, k, "t") for k, d in enumerate(docs)], "value string, doc int, text string"), keep=("doc", "text"))
    assert sorted((r.doc, r.text, r.id, r.correct) for r in found.collect()) == [(0, "t", "a", "y"), (1, "t", "a", "2"), (2, "t", "b", "")]


def test_first_lines_read_only_the_beginning(spark, tmp_path, monkeypatch):
    for name, data in (("a.jsonl", b'{"x": 1}\r\nrest'), ("empty.jsonl", b""), ("long.jsonl", b'{"y": "' + b"z" * 20_000 + b'"}\n' + b"w" * 3_000_000), ("bare.jsonl", b'{"z": 1}'), ("_hidden", b"no")):
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[-1]: r.value for r in files.first_lines(spark, str(tmp_path)).collect()}
    assert {k: v and v[:8] for k, v in found.items()} == {"a.jsonl": '{"x": 1}', "empty.jsonl": None, "long.jsonl": '{"y": "z', "bare.jsonl": '{"z": 1}'}
    reads = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read(self, n):
            reads.append(n)
            return self.file.read(n)

    class System:
        def open_input_file(self, path):
            from pyarrow import fs

            return Counting(fs.LocalFileSystem().open_input_file(path))

    monkeypatch.setattr(hub, "opened", lambda p: (System(), p))
    assert len(list(hub.FirstLinesReader([]).read(hub.Files((str(tmp_path / "long.jsonl"),))))) == 1
    assert sum(reads) <= 20_000 + 2 * hub.READ_BYTES
    monkeypatch.setattr(files, "OPENED", ())  # as in a store that only Spark reads
    assert {r.path.rsplit("/", 1)[-1]: r.value for r in files.first_lines(spark, str(tmp_path)).collect()} == found


def test_hub(spark, tmp_path):
    spark.range(100).withColumn("s", F.lit("x")).repartition(2).write.parquet(str(tmp_path / "some/set/default/train"))
    spark.range(5).withColumn("s", F.lit("y")).write.parquet(str(tmp_path / "some/set/default/val"))
    found = hub.splits(spark, f"file://{tmp_path}", "some/set")
    assert sorted(found) == ["train", "val"] and found["train"].columns == ["id", "s"] and found["train"].where("id >= 90").count() == 10
    assert hub.splits(spark, str(tmp_path), "some/set", columns="s string")["val"].collect() == [("y",)] * 5
    reader = hub.HubReader(str(tmp_path / "some/set/default/train"), ["s"])
    assert len(reader.partitions()) == 2 and {n for p in reader.partitions() for b in reader.read(p) for n in b.schema.names} == {"s"}
    with pytest.raises(KeyError):
        hub.splits(spark, str(tmp_path), "some/other")


def test_a_stream_that_stopped_goes_on(spark, tmp_path):
    config = infer.Config("d", "q", "a")
    run = lambda: records.caught_up(records.unified_stream(records.json_stream(spark, str(tmp_path / "in"), "i long, q string, a string", 1), config, "i"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"i": {k}, "q": "x", "a": "y"}}\n')
    assert run().count() == 3 and run().count() == 3
    (tmp_path / "in" / "9.json").write_text('{"i": 9, "q": "x", "a": "y"}\n')
    # a query that is stopped before it has written leaves nothing behind, and the next one starts again
    halted = records.unified_stream(records.json_stream(spark, str(tmp_path / "in"), "i long, q string, a string"), config, "i").select(F.raise_error(F.lit("halted")).cast("string").alias("x"))
    with pytest.raises(Exception, match="halted"):
        halted.writeStream.format("parquet").option("path", str(tmp_path / "other")).option("checkpointLocation", str(tmp_path / "other-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in run().select("extra_info.index").collect()) == [0, 1, 2, 9]


def asking(log: str, fails: bool):
    """A client that notes every prompt in a file, and fails at some."""

    def ask(prompt, system):
        if fails and int(prompt[1:]) % 7 == 3:
            raise OSError("no reply")
        with open(log, "a") as file:
            file.write(prompt + "\n")
        return prompt.upper()

    return lambda: ask


def test_annotation_goes_on_where_it_failed(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k == 50 else f"p{k % 30}") for k in range(60)], "k int, prompt_digest string")
    log, path = str(tmp_path / "log"), str(tmp_path / "replies")
    run = lambda fails: annotate.annotate_once(df, F.col("prompt_digest"), "reply", path, asking(log, fails), at_once=1, block=5)
    with pytest.raises(Exception, match="no reply"):
        run(True)
    kept = {r.reply for r in annotate.stored_replies(spark, path).collect()}
    assert len(kept) < 30
    before = open(log).read().split() if (tmp_path / "log").exists() else []
    found = {r.k: r.reply for r in run(False).collect()}
    assert found == {k: None if k == 50 else f"P{k % 30}" for k in range(60)}
    again = open(log).read().split()[len(before) :]
    assert len(again) == len(set(again)) == 30 - len(kept)  # each that was left, once
    assert run(True).count() == 60 and open(log).read().split()[len(before) + len(again) :] == []
    assert annotate.annotate_once(df.limit(0), F.col("prompt_digest"), "reply", str(tmp_path / "none")).collect() == []


def test_quarantine(spark, tmp_path):
    schema = "data_source string, prompt array<struct<role:string,content:string>>, ability string, reward_model struct<ground_truth:string>, extra_info struct<index:int>, broken string"
    rows = [("d", [("user", "x")], "a", ("1",), (0,), "own"), ("d", [], "a", ("1",), (1,), None), ("d", None, "a", (None,), (2,), None), ("d", [("user", None), (None, "y")], "a", None, (3,), None), ("d", [("user", "x")], "a", (None,), (4,), None)]
    df = spark.createDataFrame(rows, schema)
    extra = {"has a truth": F.col("reward_model.ground_truth").isNotNull()}
    good, bad = validate.quarantined(df, str(tmp_path / "q"), extra, name="rules")
    assert [r.extra_info["index"] for r in good.collect()] == [0] and good.columns == df.columns
    assert {r.extra_info["index"]: r.rules for r in bad.collect()} == {1: ["prompt has a turn"], 2: ["prompt has a turn", "has a truth"], 3: ["turns are whole", "has a truth"], 4: ["has a truth"]}
    counts = {r.rule: r.violations for r in validate.violations(df, extra=extra).collect()}
    assert counts == {"prompt has a turn": 2, "turns are whole": 1, "has a truth": 3}
    empty = validate.quarantined(df.limit(0), str(tmp_path / "e"), name="rules")
    assert [t.count() for t in empty] == [0, 0]


def test_row_groups_of_a_hub_are_read_in_bounded_batches(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lodestar.sources import hub

    texts = [f"{k} " * 4000 for k in range(2000)]
    pq.write_table(pa.table({"id": range(2000), "text": texts}), tmp_path / "a.parquet", use_dictionary=False)
    reader = hub.HubReader(str(tmp_path), ["id", "text"])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [t for b in batches for t in b.column(1).to_pylist()] == texts
    assert max(b.nbytes for b in batches) <= 2 * hub.BATCH_BYTES
