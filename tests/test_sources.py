import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.plans.registry import ScriptedModel, build, register, registered
from quillstone.sources import readers, sinks
from quillstone.streaming import ingest


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "x": "b"}\n')
    (path / "b.jsonl").write_text('{"id": 3, "x": "c"}\n{"id": 4, "x"')
    (path / ".hidden.jsonl").write_text('{"id": 9, "x": "z"}\n')
    return path


def test_three_strictnesses(spark, lines):
    schema = "id int, x string"
    assert readers.jsonl_strict(spark, f"{lines}/a.jsonl", schema).count() == 2
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, f"{lines}/b.jsonl", schema).collect()
    assert [r["id"] for r in readers.jsonl_lenient(spark, f"{lines}/b.jsonl", schema).collect()] == [3]
    rows = readers.jsonl_counted(spark, f"{lines}/b.jsonl", schema).cache()
    assert rows.where("_corrupt is not null").count() == 1 and rows.count() == 2


def test_directory_is_pruned_by_stem(spark, lines):
    schema = "id int, x string"
    assert {r["stem"] for r in readers.directory(spark, str(lines), schema).collect()} == {"a", "b"}
    assert {r["stem"] for r in readers.directory(spark, str(lines), schema, include=["a"]).collect()} == {"a"}
    assert {r["stem"] for r in readers.directory(spark, str(lines), schema, exclude=["a"]).collect()} == {"b"}


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids").write_text("# head\np1\n p2 # note\n\np3,title\n")
    get = lambda g: [r["id"] for r in readers.id_list(spark, f"{tmp_path}/ids", g).collect()]
    assert get("lines") == ["p1", "p2 # note", "p3,title"]
    assert get("trailing") == ["p1", "p2", "p3,title"]
    assert get("first_field")[-1] == "p3"
    with pytest.raises(ValueError):
        get("other")


def test_archives_and_pdf_checks(spark, tmp_path):
    good = b"%PDF-1.7\n" + b"x" * 2000 + b"\n%%EOF\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.pdf", good)
        z.writestr("two.PDF", b"nothing")
        z.writestr("three.txt", b"skip")
    (tmp_path / "b.zip").write_bytes(b"broken")
    rows = {(r["member"], r["status"]) for r in readers.archive_members(spark, f"file://{tmp_path}").collect()}
    assert rows == {("one.pdf", "ok"), ("two.PDF", "not_pdf"), (None, "bad_archive")}
    cases = [(1, bytearray(good)), (2, bytearray(b"x")), (3, bytearray(b"y" * 3000)), (4, bytearray(b"%PDF-" + b"y" * 3000)), (5, None)]
    df = spark.createDataFrame(cases, "id int, content binary")
    got = {r["id"]: r["v"] for r in df.select("id", readers.pdf_verdict(F.col("content")).alias("v")).collect()}
    assert got == {1: "ok", 2: "too_small", 3: "no_header", 4: "no_trailer", 5: "too_small"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1.5, None), ("p2", None, "b|c")], "paper_id string, x double, y string")
    sinks.write_jsonl(df, f"{tmp_path}/j", single=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    sinks.write_per_paper(df, f"{tmp_path}/per")
    sinks.write_per_paper(df.where("paper_id = 'p1'").withColumn("x", F.lit(9.0)), f"{tmp_path}/per")
    assert {r["paper_id"]: r["x"] for r in spark.read.parquet(f"{tmp_path}/per").collect()} == {"p1": 9.0, "p2": None}
    text = spark.createDataFrame([(2, "b"), (1, "a"), (3, "  ")], "n int, value string")
    assert sinks.concatenate(text, f"{tmp_path}/text", ["n"]) == 2
    assert sinks.markdown_table(df.orderBy("paper_id")).splitlines()[2:] == ["| p1 | 1.500 | - |", "| p2 | - | b\\|c |"]
    assert sinks.index_rows(df, {"paper_id": "string", "y": "string"}, ["y"]).columns == ["y"]


def test_options_and_queries(spark):
    record = spark.sql("SELECT 'q1' AS query_id, CAST(NULL AS map<string,string>) AS options, named_struct('multiple_choice', named_struct('options', map('A', 'x'))) AS answer")
    assert readers.options(record).collect()[0]["options"] == {"A": "x"}
    samples = spark.sql("SELECT * FROM VALUES ('q1', ' Same  Q', CAST(NULL AS map<string,string>)), ('q2', 'other', NULL) AS t(query_id, question, options)")
    known = spark.sql("SELECT * FROM VALUES ('q1', 'same q', map('A', 'x')), ('q2', 'different', map('A', 'y')) AS t(query_id, question, options)")
    got = {r["query_id"]: r["options"] for r in readers.guarded_options(samples, known).collect()}
    assert got == {"q1": {"A": "x"}, "q2": None}


def test_ingest_resumes(spark, lines, tmp_path):
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/ck"
    (lines / "b.jsonl").write_text('{"id": 3, "x": "c"}\n{"id": 1, "x": "again"}\n')
    run = lambda: ingest.ingest(spark, str(lines), "id int, x string", target, checkpoint, "id", files_per_batch=1)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    run()
    (lines / "c.jsonl").write_text('{"id": 7, "x": "n"}\n')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 7]


def test_registry_and_scripted_model():
    register("reranker", "test")(lambda: 5)
    assert build("reranker", "test") == 5 and "test" in registered("reranker")
    with pytest.raises(KeyError):
        build("reranker", "absent")
    with pytest.raises(ValueError):
        register("kind", "x")
    model = ScriptedModel(["a", "b"])
    assert [model(str(i)) for i in range(3)] == ["a", "b", "b"] and model.prompts == ["0", "1", "2"]


def test_prompt_template():
    assert readers.prompt_template("# note\nAsk {question}") == "Ask {question}"
    with pytest.raises(ValueError):
        readers.prompt_template("none")


def test_json_documents_blocks_and_distinct_values(spark, tmp_path):
    path = tmp_path / "docs"
    path.mkdir()
    (path / "a.json").write_text('[{"id": 1, "venue": " ACL "}, {"id": 2, "venue": ""}]')
    (path / "b.json").write_text('{"id": 3, "venue": "ACL"}')
    (path / "c.json").write_text('{"id": 4')
    rows = readers.json_documents(spark, str(path), "id int, venue string", "id")
    assert sorted((r["id"], r["file"]) for r in rows.collect()) == [(1, "a.json"), (2, "a.json"), (3, "b.json")]
    assert [r["venue"] for r in readers.distinct_values(rows, "venue").collect()] == ["ACL"]
    papers = spark.createDataFrame([("p1",), ("p2",)], "paper_id string")
    blocks = spark.createDataFrame([("p1", 0, "x"), ("p1", 1, "y")], "paper_id string, pos int, text string")
    assert sorted(map(tuple, readers.blocks_or_nothing(papers, blocks).collect()), key=str) == [("p1", 0, "x"), ("p1", 1, "y"), ("p2", None, None)]
    meta = spark.createDataFrame([("p1", "u"), ("", "u"), ("p3", None)], "paper_id string, pdf_url string")
    assert [r["paper_id"] for r in readers.valid_metadata(meta).collect()] == ["p1"]


def test_queries_of_production_read_no_answers(spark):
    record = spark.sql("SELECT 'q' AS query_id, 'w' AS question, array('x') AS answer_types, 's' AS table_schema, map('A', 'own') AS options, 'secret' AS gold")
    known = spark.sql("SELECT 'q' AS query_id, map('A', 'known') AS options")
    assert readers.queries(record, known).collect()[0]["options"] == {"A": "own"}
    row = readers.queries(record, known, production=True).collect()[0]
    assert row["options"] == {"A": "known"} and "gold" not in row.asDict()


def test_configuration_csv_keys_and_provenance(spark, tmp_path):
    from quillstone.plans import models

    (tmp_path / "c.yaml").write_text("a: 1\nb: [x, y]\n")
    (tmp_path / "empty.yaml").write_text("")
    assert readers.configuration(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x", "y"]} and readers.configuration(str(tmp_path / "empty.yaml")) == {}
    df = spark.createDataFrame([(2, "b,c"), (1, "a"), (2, "b,c")], "id int, x string")
    sinks.write_csv(df, f"{tmp_path}/csv", ["x", "id"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["x", "id"] and sorted(map(tuple, back.collect())) == [("a", "1"), ("b,c", "2"), ("b,c", "2")]
    sinks.write_keys(df, f"{tmp_path}/keys", "id")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/keys").collect()] == ["1", "2"]
    known = models.provenance({"k": 3}, str(tmp_path))
    assert known["arguments"] == {"k": "3"} and known["revision"] is None


def test_the_library_stands_without_the_training_data_operators(tmp_path):
    """A copy without quillstone/llm, tests/llm and the pipeline: the entry imports and a query runs."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op') or n == 'pipeline'], q.keys(); assert set(e.oracle_sql()) <= set(q); import tests.test_catalog, tests.test_plans"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-2000:]
