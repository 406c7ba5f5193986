"""Inference, files, annotation and streams."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.operators import annotate
from lodestar.plans import convert, infer
from lodestar.sources import files, sinks
from lodestar.streaming import records


def test_inference(spark):
    rows = spark.createDataFrame([(k, None, f"p{k}", f"x #### {k}", "algebra", "m") for k in range(60)], "i int, question string, problem string, answer string, subject string, source string")
    found = infer.inferred("some/OpenMath-1", {"train": rows}, "i")
    assert (found.question, found.answer, found.topic, found.extractor, found.ability, found.prefix) == ("problem", "answer", "subject", "after_hash4", "math", "some_openmath_1")
    assert found.passthrough == ("source",) and found.strategy.kind == "stratified"
    made = convert.converted({"train": rows}, found, "i").collect()
    assert len(made) == 60 and sum(r["extra_info"]["split"] == "val" for r in made) == 1
    assert {r["reward_model"]["ground_truth"] for r in made} == {str(k) for k in range(60)}
    assert "p0" in infer.preview(found, rows)


def test_existing_splits_are_numbered_apart(spark):
    train = spark.createDataFrame([(k, f"q{k}", "1") for k in range(5)], "i int, question string, answer string")
    config = infer.inferred("d", {"train": train, "test": train.where("i < 2")}, "i")
    made = [r["extra_info"] for r in convert.converted({"train": train, "test": train.where("i < 2")}, config, "i").collect()]
    assert sorted((r["split"], r["index"]) for r in made) == [("train", k) for k in range(5)] + [("val", 0), ("val", 1)]


def test_inference_of_splits(spark):
    rows = spark.createDataFrame([("a", "b")], "x string, y string")
    found = infer.inferred("d", {"main": rows, "dev": rows})
    assert (found.train, found.val, found.strategy.kind, found.question, found.answer) == ("main", "dev", "existing", "x", "y")
    with pytest.raises(ValueError):
        infer.inferred("d", {"test": rows})


@pytest.mark.parametrize("answers, extractor", [(["a #### 1"], "after_hash4"), ([r"\boxed{1}"], "boxed"), ([r"\boxed{1", "x"], "copy"), ([r"\boxed{1", "x}"], "boxed"), (["1 2", "3 4 5"], "numeric"), (["x", None], "copy"), ([], "copy")])
def test_guesses(spark, answers, extractor):
    made = spark.createDataFrame([(answers,)], "a array<string>").select(infer.guessed_extractor(F.col("a")))
    assert made.first()[0] == extractor


def test_formats():
    assert files.formats({"train": ["a.CSV", "b.jsonl"], "val": None}) == "json"
    assert files.formats(["a.csv", "b.parquet"]) == "parquet" and files.formats("x.csv") == "csv" and files.formats("x.txt") == "json"


def test_csv_in_japanese(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,"問\n題"\n1,"行\n""二"""\nNA,x\n'.encode("cp932"))
    table = files.csv(spark, str(tmp_path / "a.csv"), "cp932", na=("NA",))
    assert table.columns == ["id", "問\n題"] and [tuple(r) for r in table.collect()] == [("1", '行\n"二"'), (None, "x")]


def test_csv_dialect(spark, tmp_path):
    rows = spark.createDataFrame([(' a"b ', None, "")], "x string, y string, z string")
    sinks.csv_with_mark(rows.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert written.startswith(b"\xef\xbb\xbfx,y,z") and b'" a""b ",,' in written


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k else "é") for k in range(120)], "i int, v string")
    sinks.jsonl(rows, str(tmp_path / "out"), 100, "i")
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 100 and lines[0] == {"i": 0, "v": "é"} and lines[1] == {"i": 1, "v": None}
    assert sinks.size_mb(rows, str(tmp_path / "out")) > 0


def test_first_line_keys(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b": 1, "a": 2}\nrest')
    (tmp_path / "b.jsonl").write_text("bad")
    found = files.first_line_keys(spark, str(tmp_path))
    sinks.key_table(found, str(tmp_path / "keys"))
    assert {r["filename"]: r["keys"] for r in found.collect()} == {"a.jsonl": ["b", "a"], "b.jsonl": []}


def test_command_output(spark, tmp_path):
    (tmp_path / "sinfo.txt").write_text("NODELIST  GRES   GRES_USED\nn1  gpu:X:8  gpu:X:2\n\n")
    found = files.command_output(spark, str(tmp_path / "sinfo.txt"), "NODE", "GRES", "GRES_USED").collect()
    assert [tuple(r) for r in found] == [("n1", "gpu:X:8", "gpu:X:2")]


def test_split_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string")
    paths = sinks.split_parquet(rows, str(tmp_path), "p")
    assert [spark.read.parquet(p).first()[0] for p in paths] == [1, 2]
    loaded = files.load(spark, {"train": paths[0] + "/*.parquet", "val": None})
    assert list(loaded) == ["train"] and loaded["train"].count() == 1
    assert files.chosen_splits(loaded, None, "val")[1] is None
    with pytest.raises(Exception, match="no such split: null"):
        sinks.split_parquet(spark.createDataFrame([(1, "train"), (2, None)], "i int, split string"), str(tmp_path), "q")


def test_annotation_over_http(spark):
    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"Text": body.split("&")[1]} if "hello" in body else {}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([("hello",), ("bye",), (None,)], "p string")
    found = {r["p"]: r["reply"] for r in annotate.annotate(df, F.col("p"), "reply", lambda: annotate.Http(url)).collect()}
    server.shutdown()
    assert found == {"hello": "userPromptText=hello", "bye": "", None: None}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"i": 1, "q": "x ", "a": "#### 5"}\n')
    config = infer.Config("d", "q", "a", extractor="after_hash4")
    stream = records.unified_stream(records.json_stream(spark, str(tmp_path / "in"), "i long, q string, a string"), config, "i")
    records.written(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["reward_model"]["ground_truth"] == "5" and row["extra_info"]["index"] == 1
