import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bytesops as B
from quillstone.llm import toxicity as X


def toy(n=400):
    r = np.random.default_rng(2)
    calm = [f"calm{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(r.choice(calm, 8)) for _ in range(int(r.integers(1, 12)))]
        toxic = i % 4 == 0
        if toxic:
            lines.insert(int(r.integers(0, len(lines) + 1)), f"you {r.choice(['slur1', 'slur2'])} " + " ".join(r.choice(calm, 3)))
        docs.append((i, ". ".join(lines) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_held_out_documents_and_finds_sentences(spark):
    docs, labels = toy()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "'y' as lang")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in X.judge(d, l).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    model = X.train(d, l)
    spans = {r["doc_id"]: r["offending"] for r in X.scored(d, model, spans=True).collect()}
    i = next(i for i in held if i % 4 == 0)
    assert any("slur" in docs[i][1][s["start"] : s["end"]] for s in spans[i])
    kept = X.drop_toxic(d, l)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_score_is_noisy_or_of_sentences():
    vocabulary = np.sort(np.array([B.hash_text(w) for w in ("bad", "good")], np.uint64))
    weights = np.array([4.0 if v == B.hash_text("bad") else -2.0 for v in vocabulary])
    model = X.Model(vocabulary, weights, -3.0)
    text = "bad bad. good thing! nothing?\n\nBAD"
    raw = np.frombuffer(text.encode(), np.uint8)
    score, (starts, ends, rows, chance) = model.score(raw, np.array([0, len(raw)]))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = [sigmoid(1.0), sigmoid(-5.0), sigmoid(-3.0), sigmoid(1.0)]
    solid = [c for c, a, b in zip(chance, starts, ends) if text[a:b].strip()]
    assert np.allclose(solid, want)
    assert np.isclose(score[0], 1 - np.prod(1 - chance))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "."), (3, "a b"), (None, "c " * 100000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = X.judge(docs, none).collect()
    assert len(rows) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert X.judge(docs, odd).count() == 5
    assert X.judge(docs.limit(0), odd).count() == 0


def test_overlong_labelled_text_is_skipped_and_the_rest_fitted(spark):
    docs, labels = toy(200)
    first = min((i for i, _ in docs), key=lambda i: spark.sql(f"SELECT xxhash64({i}L)").first()[0])
    docs = [(i, "x " * 300_000 if i == first else t) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([(i, q, 1 if i == first else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    model = X.train(d, l, most_bytes=400_000, row_bytes=100_000)
    without = X.train(d.where(F.col("doc_id") != first), l)
    assert len(model.vocabulary) and (model.vocabulary == without.vocabulary).all() and np.allclose(model.weights, without.weights)
    assert not len(X.train(d, l, most_bytes=10).vocabulary)


def test_fit_equals_a_plain_loop_and_gradients_of_the_likelihood():
    r = np.random.default_rng(5)
    bags, labels = [], r.integers(0, 2, 30)
    for y in labels:
        n = int(r.integers(1, 4))
        k = int(r.integers(1, 6))
        pair = np.unique(r.integers(0, n, k) * 5 + np.where(y and r.random(k) < 0.5, 0, r.integers(0, 5, k)))
        bags.append((pair % 5, pair // 5, n))

    def loss(x):
        total = 0.0
        for (word, sentence, n), y in zip(bags, labels):
            clean = 1.0
            for s in range(n):
                clean *= 1 - 1 / (1 + np.exp(-(x[-1] + sum(x[w] for w, t in zip(word, sentence) if t == s))))
            total += X.POSITIVE * np.log(1 - (1 - X.NOISE) * clean) if y else np.log(clean)
        return total / len(labels) - X.DECAY / 2 * (x[:-1] ** 2).sum()

    x = np.append(np.zeros(5), -np.log(sum(b[2] for b in bags) / 30) - 2.0)
    first = second = np.zeros(6)
    for step in range(1, 41):
        # slopes by differences of the likelihood itself
        grad = np.array([(loss(x + e) - loss(x - e)) / 2e-5 for e in np.eye(6) * 1e-5])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        x = x + X.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
    model = X.fit(np.arange(5).astype(np.uint64), bags, labels, 40)
    got = np.append(np.zeros(5), model.bias)
    got[model.vocabulary.astype(int)] = model.weights
    assert np.allclose(got, np.where(np.append(x[:-1], 1) > 0.01, x, 0), atol=1e-3)


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.judge(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in rows}
    assert share[1] >= 0.9 and share[0] <= 0.015
