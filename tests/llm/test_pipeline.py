"""The pipeline against a plain version of each stage, and the guards around it."""

import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quillstone.llm import bytesops as B
from quillstone.llm import piece_matching, toxicity
from tests.llm.test_line_dedup import brute as lines_of
from tests.llm.test_order_minhash import brute as classes_of

pytestmark = pytest.mark.skipif(not os.path.exists(piece_matching.MODEL), reason="no tokenizer files")

ITEM = "the small boat crosses the wide river with 12 sacks of grain and returns before 6 in the evening to load again"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "ro", "vel", "da", "p")]
    text = lambda n: ". ".join(" ".join(r.choice(vocabulary) for _ in range(8)) for _ in range(n)) + "."
    docs, labels = [], []
    for i in range(160):
        body = text(r.randint(2, 6))
        if i % 5 == 0:
            body = f"you vile{r.choice(['x', 'y'])} {body}"
        if i % 7 == 0:
            body += "\nAll rights reserved by nobody"
        if i % 40 == 3:
            body += "\n" + ITEM
        docs.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(200 + i, docs[8 + i][1].replace(" kan ", " mis ", 1), "en", "s", 1) for i in range(6)]
    docs += [(300, docs[1][1], "en", "s", 1), (301, None, None, None, None), (302, "", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_score(model, text):
    weights = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))
    clean = 1.0
    for sentence in re.split(rb"[.!?\n\r|]+", (text or "").encode()):
        if not sentence:
            continue
        features = set()
        for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+", sentence):
            w = w.lower()
            hash_ = lambda x: int(B.span_hash(B.prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0])
            features.add(hash_(w))
            features |= {int(B.mix(np.array([hash_(w[:n]) ^ n], np.uint64))[0]) for n in toxicity.PREFIXES}
        clean *= 1 / (1 + np.exp(model.bias + sum(weights.get(f, 0.0) for f in features)))
    return 1 - clean


def test_run_matches_plain_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if plain_score(model, t) < 0.5]
    assert all(i >= 200 or i % 5 for i, _ in rows) and len(rows) > 120
    rows = [(i, text) for i, _, _, text in lines_of(rows, 10)]
    classes = classes_of(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    rows = [(i, t) for i, t in rows if ITEM not in t]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_matching.MODEL)
    want = {i: library.encode(t) for i, t in rows}
    got = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), tables)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and stage(spark, docs, tables).columns == docs.columns


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/quillstone", tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
