"""Selections and the shells around injected models."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import selections as S
from quillstone.plans import models as M


def test_include_exclude(spark):
    rows, pick = spark.range(6).withColumnRenamed("id", "k"), lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    got = lambda df: sorted(r["k"] for r in df.collect())
    assert got(S.include_exclude(rows, "k")) == [0, 1, 2, 3, 4, 5]
    assert got(S.include_exclude(rows, "k", pick(1, 2, 9), pick(2))) == [1]
    assert got(rows.where(S.equals_all(k=3))) == [3] and rows.where(S.equals_all(k=None)).count() == 6


def test_selected_records(spark):
    records = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "paper_id string, pos int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "paper_id string")
    kept, unknown = S.selected_records(records, [ids("a", "z"), ids("b")], ids("b"))
    assert [r["paper_id"] for r in kept.collect()] == ["a"] and [r["paper_id"] for r in unknown.collect()] == ["z"]


def test_empty_answers(spark):
    rows = spark.sql("""SELECT 1 AS id, named_struct('freeform', named_struct('text', ' '), 'multiple_choice', named_struct('gold', CAST(NULL AS string)), 'table', named_struct('rows', CAST(array() AS array<string>))) AS answer, CAST(array() AS array<string>) AS papers
        UNION ALL SELECT 2, named_struct('freeform', named_struct('text', 'x'), 'multiple_choice', named_struct('gold', ''), 'table', named_struct('rows', array('r'))), array('p')""")
    got = {r["id"]: (r["e"], r["r"]) for r in rows.select("id", S.answer_empty(F.col("answer")).alias("e"), S.retryable(F.col("answer"), F.col("papers")).alias("r")).collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_paths_prefer_exact_names(spark):
    papers = spark.createDataFrame([("Paper-1", ["x.pdf", "p1.pdf"]), ("Paper 2", ["none.pdf"]), ("P3", ["none"])], "paper_id string, names array<string>")
    files = spark.createDataFrame([("d/p1.pdf",), ("d/paper1.pdf",), ("e/paper_2.pdf",)], "path string")
    assert {r["paper_id"]: r["path"] for r in S.resolve_paths(papers, files).collect()} == {"Paper-1": "d/p1.pdf", "Paper 2": "e/paper_2.pdf", "P3": None}


def test_scores_of_failed_questions(spark):
    gold = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    recalls = spark.createDataFrame([("q1", 1, 0.5), ("q1", 5, 1.0)], "query_id string, k int, recall double")
    scores = S.question_scores(gold, recalls)
    summary = {r["k"]: (r["recall"], r["n_complete"], r["n_failed"]) for r in S.score_summary(scores).collect()}
    assert summary == {1: (0.25, 0, 1), 5: (0.5, 1, 1)}
    base = spark.createDataFrame([(1, 0.2)], "k int, recall double")
    assert {r["k"]: r["delta"] for r in S.against_baseline(S.score_summary(scores), base).collect()} == {1: 0.05, 5: None}
    assert S.report_level([1, 8, 20]) == 8 and S.report_level([1, 5, 20]) == 5


def test_chunk_record_and_small_extractors(spark):
    row = spark.sql("SELECT array(3, 1, 3, 0) AS pages, map('section', 'own') AS locator, 'given' AS section")
    pages, locator = S.chunk_record(F.col("pages"), F.col("locator"), F.col("section"))
    got = row.select(pages.alias("p"), locator.alias("l")).collect()[0]
    assert got["p"] == [1, 3] and got["l"] == {"section": "own", "page": "1"}
    names = spark.createDataFrame([([" a ", "a", "", "b" * 81] + [f"n{i}" for i in range(20)],)], "n array<string>")
    assert names.select(S.compared_methods(F.col("n"))).collect()[0][0] == ["a"] + [f"n{i}" for i in range(7)]
    with pytest.raises(ValueError):
        S.batches(spark.range(3), [F.col("id")], 0)
    assert [r["batch"] for r in S.batches(spark.range(5), [F.col("id")], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_embedding_shell(spark):
    def model(texts):
        if len(texts[0]) > 1000:
            raise OverflowError
        if texts[0].startswith("bad"):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "x" * 5000), (2, "bad"), (3, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in M.embed(rows, model, 2).collect()}
    assert got[1][0] <= 1000 and got[2] is None and got[3] == [0.0, 1.0]
    with pytest.raises(Exception):
        M.embed(rows, model, 3).collect()


def test_figures_fall_back_to_captions(spark):
    rows = spark.createDataFrame([(1, "cap", None), (2, None, "p.png"), (3, None, None), (4, "c", "q.png")], "id int, caption string, image_path string")
    assert {r["id"]: r["text"] for r in M.describe(rows).collect()} == {1: "cap", 2: "", 4: "c"}
    assert {r["id"]: r["text"] for r in M.describe(rows, lambda p: "seen" if p == "p.png" else None).collect()} == {1: "cap", 2: "seen", 4: "c"}


def test_families_wordings_and_filters(spark):
    queries = spark.createDataFrame([(1, "which papers do x", None), (2, "one thing", "multi_paper"), (3, "one thing", None)], "query_id int, text string, task_family string")
    verdicts = spark.createDataFrame([(3, 0, "multi_paper"), (3, 1, "nonsense"), (2, 0, "hidden_source_single_paper")], "query_id int, pos int, task_family string")
    assert {r["query_id"]: r["task_family"] for r in M.infer_families(queries, verdicts).collect()} == {1: "multi_paper", 2: "multi_paper", 3: "multi_paper"}
    proposed = spark.createDataFrame([(1, 1, "Which papers do X"), (1, 2, "second"), (1, 3, " ")], "query_id int, sub_no int, text string")
    assert [(r["sub_no"], r["text"]) for r in M.wordings(queries.where("query_id = 1"), proposed).orderBy("sub_no").collect()] == [(0, "which papers do x"), (1, "second")]
    plans = spark.createDataFrame([(1, " acl", 2020), (2, "none", 1)], "query_id int, venue string, year int")
    venues = spark.createDataFrame([("ACL",)], "venue string")
    assert {r["query_id"]: (r["venue"], r["year"]) for r in M.scoped_filters(plans, venues).collect()} == {1: ("ACL", 2020), 2: (None, None)}


def test_answer_retries():
    calls = []

    def ask(prompt, budget):
        calls.append(budget)
        if len(calls) == 1:
            raise OverflowError
        return 'so: {"a": 1}'

    assert M.answer_with_retries(ask, "q", 10) == {"a": 1} and calls == [10, 20]
    assert M.answer_with_retries(lambda p, b: "no", "q") is None


def test_enumeration_groups_and_vision(spark):
    hits = spark.createDataFrame([(1, "r", i, i, i, 1.0) for i in range(1, 30)], "query_id int, run string, rank int, chunk_id int, doc_id int, score double")
    kept = M.corpus_enumeration(hits, lambda c: c.where("doc_id % 2 = 0"))
    assert [r["doc_id"] for r in kept.orderBy("rank").collect()] == [2, 4, 6, 8, 10, 12, 14, 16]
    start = spark.createDataFrame([(1, 5, 0)], "query_id int, doc_id int, order int")
    new = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3), (1, 8, 4), (1, 9, 5)], "query_id int, doc_id int, rank int")
    assert sorted(r["doc_id"] for r in M.grow_group(start, lambda g: new, 4, 2).collect()) == [5, 6, 7, 8]
    answers = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, answer string")
    vision = spark.createDataFrame([(1, "x", True), (2, "y", None)], "query_id int, answer string, confident boolean")
    assert {r["query_id"]: r["answer"] for r in M.confident_only(answers, vision).collect()} == {1: "x", 2: "b"}


def test_upload_tries_again(spark):
    seen = {}

    def send(records):
        out = []
        for r in records:
            seen[r["id"]] = seen.get(r["id"], 0) + 1
            out.append(r["id"] != 3 and (r["id"] != 2 or seen[r["id"]] > 1))
        return out

    got = {r["id"]: (r["status"], r["attempts"]) for r in M.upload(spark.range(1, 4).coalesce(1), send, "id").collect()}
    assert got == {1: ("ok", 1), 2: ("ok", 2), 3: ("refused", 3)}


def test_ordinals_over_many_ranges(spark, monkeypatch):
    from quillstone.operators import logs

    monkeypatch.setattr(logs, "RANGE_ROWS", 40)
    rows = spark.createDataFrame([(i * 7 % 1000, f"k{i % 13:02d}") for i in range(1000)], "n long, s string").repartition(5)
    got = [(r["i"], r["s"], r["n"]) for r in logs.ordinals(rows, [F.col("s"), F.col("n")], "i").orderBy("i").collect()]
    want = sorted((f"k{i % 13:02d}", i * 7 % 1000) for i in range(1000))
    assert got == [(i, s, n) for i, (s, n) in enumerate(want)]
    assert {r["n"] for r in logs.shard_modulo(rows, F.col("n"), 2, 5).collect()} == {n for n in range(1000) if n % 5 == 2}
    hot = spark.createDataFrame([("same",)] * 300, "s string")
    assert sorted(r["i"] for r in logs.ordinals(hot, [F.col("s")], "i").collect()) == list(range(300))
