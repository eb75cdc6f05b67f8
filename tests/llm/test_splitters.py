import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import splitters as S
from quillstone.llm.runtime import Scratch


def brute(rows, shards):
    keyed = sorted((hashlib.md5((t or "").encode()).hexdigest(), -(1 << 63) if i is None else i, i, t or "") for i, t in rows)
    total = sum(len(t.encode()) + 1 for *_, t in keyed)
    before, slots, out = 0, [0] * shards, []
    for _, _, i, t in keyed:
        s = min(shards - 1, before * shards // total)
        out.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", s, slots[s], None))
        slots[s] += 1
        before += len(t.encode()) + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes, width", [(64, 32), (64, 2), (1 << 20, 32)])
def test_matches_brute_force(spark, monkeypatch, range_bytes, width):
    monkeypatch.setattr(S, "WIDTH", width)
    rows = [(i, "hot copy" if i % 3 == 0 else f"téxt {i} " * (i % 17)) for i in range(400)] + [(1000, "long " * 5000), (None, None), (None, ""), (7, "hot copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as shard")
    got = sorted((tuple(r) for r in S.assign(docs, 8, range_bytes=range_bytes).collect()), key=str)
    assert got == brute(rows, 8)
    sizes = [0] * 8
    for r in got:
        sizes[r[4]] += r[1]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_empty_and_few(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.assign(docs).count() == 0
    one = S.assign(spark.createDataFrame([(3, "x")], "doc_id long, text string")).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]


def test_no_range_of_two_keys_stays_overfull(spark, monkeypatch):
    """A sample too thin for good splitters, hot texts and long rows: ranges are divided until they fit."""
    monkeypatch.setattr(S, "SAMPLE", 1)
    rows = [(i, "hot copy" if i % 3 == 0 else f"text {i} " * (i % 29)) for i in range(1500)] + [(5000, "long " * 9000), (5001, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch(spark, "t") as scratch:
        keyed = scratch.table(S.keyed(docs))
        total = keyed.agg(F.sum("size")).first()[0]
        splitters = S.divided(keyed, total, 40, scratch)
        first = scratch.table(S.quantiles(S.drawn(keyed, total / 40, 1).select("key", "weight"), F.lit(40), F.lit(0)))
        load = lambda s: S.ranged(keyed, s).groupBy("range").agg(F.sum("size").alias("bytes"), F.count_distinct("key").alias("n"))
        over = (F.col("bytes") > 1.5 * total / 40) & (F.col("n") > 1)
        assert load(first).where(over).count() > 0
        assert load(splitters).where(over).count() == 0
        cuts = sorted((r["k1"], r["k2"]) for r in splitters.collect())
        for r in S.ranged(keyed, splitters).select("key", "range").collect():
            assert r["range"] == sum(c < (r["key"]["k1"], r["key"]["k2"]) for c in cuts)


def test_plan_has_no_python_and_no_cross_join(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    with Scratch(spark, "t") as scratch:
        keyed = scratch.table(S.keyed(docs))
        plan = S.ranged(keyed, S.divided(keyed, 200, 8, scratch))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
