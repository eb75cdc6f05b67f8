import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import line_dedup as L


def brute(rows, threshold):
    held = {}
    for n, (i, text) in enumerate(rows):
        for key in {L.key_of(x) for x in (text or "").encode().split(b"\n")} - {b""}:
            held.setdefault(key, set()).add(("null", n) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if not L.key_of(x) or len(held[L.key_of(x)]) < threshold]
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


ROWS = [(i, f"Common line\nown {i}\n") for i in range(6)] + [(6, None), (7, ""), (8, "  COMMON LINE\t\nx\nx"), (9, "\n\n"), (10, "é\x0b\nCommon line")]
# line ends of other alphabets are no white space; repeated rows of a document count once, rows without an id each
ODD = [(20 + i, f"shared line \u2028\nnext\x85 \nlast\u2029\n{i}") for i in range(4)] + [(30, "solo\nown 30")] * 5 + [(31, "solo\r\na"), (None, "lost\n1"), (None, "lost\n2"), (None, "lost\n2"), (32, "y " * 40_000 + "\nCommon line"), (33, "a"), (33, "b\nsolo")]


@pytest.mark.parametrize("shard_keys, probe_rows", [(L.SHARD_KEYS, L.PROBE_ROWS), (2, 5)])
@pytest.mark.parametrize("rows", [ROWS, ROWS + ODD, ODD])
def test_apply_matches_brute_force(spark, monkeypatch, rows, shard_keys, probe_rows):
    monkeypatch.setattr(L, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(L, "PROBE_ROWS", probe_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in L.LineIndex.build(docs, 3).apply(docs).collect()]
    assert sorted(got, key=str) == brute(rows, 3)


def test_hits_come_through_the_filters(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = L.LineIndex.build(docs, 3)
    blank = spark.createDataFrame([(0, bytes(16))], "shard long, bits binary")
    assert index.apply(docs).agg(F.sum("n_dropped")).first()[0] == 8
    assert L.LineIndex(index.counts, 3, index.shards, blank).apply(docs).agg(F.sum("n_dropped")).first()[0] == 0


def test_insert_and_delete_are_reversible(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    first, second = docs.where("doc_id < 4"), docs.where("doc_id >= 4")
    whole = {(bytes(r["key"]), r["refs"]) for r in L.LineIndex.build(docs, 3).counts.collect()}
    index = L.LineIndex.build(first, 3).insert(second)
    assert {(bytes(r["key"]), r["refs"]) for r in index.counts.collect()} == whole
    back = index.delete(second)
    alone = L.LineIndex.build(first, 3)
    assert {(bytes(r["key"]), r["refs"]) for r in back.counts.collect()} == {(bytes(r["key"]), r["refs"]) for r in alone.counts.collect()}
    assert sorted(map(str, back.apply(first).collect())) == sorted(map(str, alone.apply(first).collect()))
    gone = index.delete(docs)
    assert gone.counts.isEmpty() and gone.n_common == 0


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    f = L.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 1 << 63, (20000, 2)).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.remove(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01


def test_stage_keeps_columns_and_follows_text(spark):
    docs = spark.createDataFrame([(i, "Common line\nb" + str(i), "en", 13) for i in range(12)] + [(99, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    out = L.drop_common_lines(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["text"] == "b3" and got[3]["n_chars"] == 2
    assert got[99]["text"] == "" and got[99]["n_chars"] is None
    assert L.drop_common_lines(docs.limit(0)).count() == 0
    assert hashlib.md5(b"").digest() not in {bytes(r["key"]) for r in L.LineIndex.build(docs).counts.collect()}


def test_stage_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "Common line\nb" + str(i), 7, "mine", "r", 5) for i in range(12)], "doc_id long, text string, n_lines int, kept string, row string, n_dropped int")
    rows = L.drop_common_lines(docs)
    assert rows.schema.simpleString() == docs.schema.simpleString()
    assert {(r["text"], r["n_lines"], r["kept"], r["row"], r["n_dropped"]) for r in rows.collect()} == {(f"b{i}", 7, "mine", "r", 5) for i in range(12)}


@pytest.mark.parametrize("repeated", [False, True])
def test_stage_writes_few_tables(spark, monkeypatch, repeated):
    """Each file in a local folder starts a process, which a look at memory may take for the whole JVM once more."""
    written = []
    cut = L.cut_table
    monkeypatch.setattr(L, "cut_table", lambda df, label: (written.append(label), cut(df, label))[1])
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/quillstone"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    rows = [(i, f"Common line\nb{i}") for i in range(12)] + [(3, "solo\nCommon line")] * (3 * repeated)
    got = sorted(tuple(r) for r in L.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, kept) for i, _, _, kept in brute(rows, L.THRESHOLD))
    assert written == ["lines", "common-lines"]
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["common-lines"]
