"""Results on odd letters, and memory of a task that is bounded whatever its batches, queries and words."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillstone.operators import packing, retrieval
from quillstone.plans import catalog, derived

LETTERS = "aßŉǰΐᾀᾈᾳᾼῃῳﬁﬀևẞéΑiıſµ\U00010428\n"


@pytest.mark.parametrize("name", ["answer_values", "title_equivalence"])
def test_letters_without_a_single_capital(spark, tmp_path, name):
    items = [(i, f"Er{c}ie{c} entech and the wide{c} harbour wall {c}") for i, c in enumerate(c for c in LETTERS for _ in range(15))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = con.execute(derived.SQL[name])
    columns = [c[0] for c in want.description]
    got = derived.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


@pytest.fixture
def python_mb(spark, monkeypatch):
    """MB at most that numpy and Python hold while a step in Python works off its rows in one batch; the steps are those made since."""
    frame, calls = type(spark.range(1)), []
    for name in ("mapInArrow", "mapInPandas"):
        made = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, fn, *a, made=made, name=name, **k: (calls.append((self, fn, name)), made(self, fn, *a, **k))[1])

    def peak(at: int) -> float:
        rows, fn, name = calls[at]
        table = rows.toArrow().combine_chunks()
        batches = [table.to_pandas()] if name == "mapInPandas" else table.to_batches()
        tracemalloc.start()
        try:
            for _ in fn(iter(batches)):
                pass
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    return peak


def test_words_that_all_queries_ask_for(spark, python_mb):
    """8 million pairs of a posting and a query that asks for it, in one batch."""
    r, words = random.Random(5), [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(i, i, " ".join(r.sample(words, 40))) for i in range(1000)], "chunk_id long, doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(words)) for q in range(200)], "query_id long, text string")
    hits = retrieval.BM25Index.build(chunks).search(queries, 3)
    assert python_mb(-1) < 100
    assert [(r["rank"], r["chunk_id"]) for r in hits.where("query_id = 7").orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_passes_of_few_queries_agree(spark, monkeypatch):
    r = random.Random(6)
    text = lambda n: " ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(n))
    chunks = spark.createDataFrame([(i, i // 2, text(r.randint(0, 40))) for i in range(300)], "chunk_id long, doc_id long, text string")
    queries = spark.createDataFrame([(q, text(6)) for q in range(23)], "query_id long, text string")
    within = chunks.where("chunk_id % 3 > 0")
    found = lambda: [sorted(map(tuple, retrieval.BM25Index.build(chunks).search(queries, 4, within=w).collect())) for w in (None, within)]
    whole = found()
    monkeypatch.setattr(retrieval, "HELD_BOUND", 20)
    assert found() == whole


@pytest.mark.parametrize("size", [1, 7, 40])
def test_slices_of_few_tokens_and_pairs_agree(monkeypatch, size):
    r = random.Random(7)
    lists = [[f"w{r.randrange(9)}" for _ in range(r.choice([1, 2, 30]))] for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"chunk_id": range(50), "doc_id": range(50), "tokens": lists, "dl": pa.array(map(len, lists), pa.int32())})
    # w0, w2, w4 and w6 are asked for by queries 0 and 1, 1, none, and 0, 1 and 2
    terms, starts, asked = pa.array(["w0", "w2", "w4", "w6"]), np.array([0, 2, 3, 3, 6]), np.array([0, 1, 1, 0, 1, 2])

    def found():
        best = retrieval.Best(3, 4)
        for held in retrieval.postings_of(iter([batch.slice(0, 20), batch.slice(20)]), terms):
            for lo, row, query, score in retrieval.scores_of(held, np.array([1.0, 2.0, 3.0, 0.5]), 9.0, starts, asked, best):
                key = held.rows.column("chunk_id").to_numpy()[lo + row]
                best.add(query, score, key, key)
        return [x.tolist() for x in best.rows()]

    whole = found()
    monkeypatch.setattr(retrieval, "SLICE", size)
    assert found() == whole and len(whole[0]) == 12


def rows_made(df) -> int:
    """Rows that any operator of the plan put out, at most."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if (metrics := node.metrics()).contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
    return most


def test_second_run_keeps_the_best_of_each_task(spark, tmp_path):
    """No row for each document and each query that shares a word with it."""
    r = random.Random(9)
    texts = [" ".join(["the", *(f"w{r.randrange(30)}" for _ in range(6))]) for _ in range(2000)]
    asked = [" ".join(["The", "the", *(f"w{r.randrange(30)}" for _ in range(4))]) for _ in range(50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = catalog.shared_terms(spark, str(tmp_path), 5)
    assert rows_made(hits) < 10_000
    words = [set(t.split()) for t in texts]
    want = set()
    for q, text in enumerate(asked):
        scores = sorted((-float(len(w & set(text.lower().split()))), d) for d, w in enumerate(words))
        want |= {(q, "terms", i + 1, d, d, -s) for i, (s, d) in enumerate(scores[:5])}
    assert {tuple(x) for x in hits.collect()} == want


def test_both_ways_of_shared_terms_agree(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, i % 7, f"a{i % 3} b{i % 4} b{i % 4} c{i % 5}") for i in range(60)] + [(999, 1, None)], "chunk_id long, doc_id long, text string")
    queries = spark.createDataFrame([(i, f"a{i % 3} c{i % 5} c{i % 2} absent") for i in range(9)] + [(50, "")], "query_id long, text string")
    found = lambda: sorted(map(tuple, retrieval.BM25Index.build(chunks).search(queries, 5, by="terms").collect()))
    here = found()
    monkeypatch.setattr(retrieval, "TERMS_BOUND", 3)
    assert here == found() and len(here) == 45
    with pytest.raises(ValueError):
        retrieval.BM25Index.build(chunks).search(queries, 5, by="words")


@pytest.mark.parametrize("search", ["knn", "scoped", "max_sim"])
def test_many_vectors_in_one_batch(spark, python_mb, search):
    rng = np.random.default_rng(10)
    rows = pa.table({"chunk_id": np.arange(6000), "doc_id": np.arange(6000) // 20, "label": np.arange(6000) % 7, "vector": pa.array(list(rng.standard_normal((6000, 8))))})
    corpus = spark.createDataFrame(rows)
    queries = corpus.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    if search == "max_sim":
        hits = retrieval.max_sim(corpus, queries.selectExpr("query_id % 9 as query_id", "query_id as token_no", "vector"), 2)
    else:
        hits = retrieval.knn(corpus, queries, 4, skip_self=True, scope="label" if search == "scoped" else None)
    assert python_mb(-1) < 80
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 4)) for r in hits.collect())
    unit = (v := np.array(rows["vector"].to_pylist())) / np.linalg.norm(v, axis=1, keepdims=True)
    asked, want = np.arange(0, 6000, 3), []
    if search == "max_sim":
        best = (v[asked] @ v.T).reshape(len(asked), 300, 20).max(axis=2)
        for q in (0, 3, 6):
            score = best[asked % 9 == q].sum(axis=0)
            want += [(q, i + 1, d, round(score[d], 4)) for i, d in enumerate(np.argsort(-score.round(6), kind="stable")[:2])]
    else:
        score = unit[asked] @ unit.T
        score[np.arange(len(asked)), asked] = -9
        if search == "scoped":
            score[asked[:, None] % 7 != np.arange(6000)[None, :] % 7] = -9
        want += [(q, i + 1, d, round(score[n, d], 4)) for n, q in enumerate(asked) for i, d in enumerate(np.argsort(-score[n].round(6), kind="stable")[:4])]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-4)


def test_vectors_with_missing_components_hide_no_other(spark):
    rows = [(i, i, [float(i), 1.0]) for i in range(1, 9)] + [(i, i, [None, 1.0]) for i in range(9, 15)] + [(20, 20, None), (21, 21, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, doc_id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r["chunk_id"] for r in retrieval.knn(corpus, queries, 3).orderBy("rank").collect()] == [8, 7, 6]


def test_many_texts_to_split_in_one_batch(spark, python_mb):
    """32 MB of text in one batch, with columns of its own kinds; parts as a plain loop cuts them."""
    r = random.Random(11)
    pool = [" ".join("x" * r.choice([1, 3, 9, 400]) for _ in range(40)) for _ in range(50)]
    texts = [f" \n{r.choice(pool)}　 {r.choice(pool)} \t" for _ in range(12_000)] + ["", None, "   ", "ü" * 1500]
    rows = spark.createDataFrame(pa.table({"id": np.arange(len(texts)), "text": texts})).selectExpr("*", "timestamp'2020-01-01' + make_interval(0, 0, 0, id) as ts", "array(id) as ids")
    parts = packing.split_at_spaces(rows, 600)
    assert python_mb(-1) < 40

    def plain(text):
        out, rest = [], (text or "").strip()
        while len(rest) > 600:
            at = rest.rfind(" ", 0, 601)
            at = at if at > 300 else 600
            out.append(rest[:at].strip())
            rest = rest[at:].strip()
        return [*out, rest] if rest else out

    got = sorted((x["id"], x["part_no"], x["part"]) for x in parts.where("id % 50 = 0 or id >= 12000").collect())
    assert got == [(i, n, p) for i, t in enumerate(texts) if i % 50 == 0 or i >= 12000 for n, p in enumerate(plain(t))]
