import random

from pyspark.sql import functions as F

from quillstone.operators import packing


def scan(left, right, least):
    return next((n for n in range(min(len(left), len(right)), max(least, 1) - 1, -1) if left.endswith(right[:n])), 0)


def test_overlap_size_equals_scan():
    r = random.Random(3)
    for _ in range(3000):
        left, right = ("".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(2))
        least = r.randint(0, 4)
        assert packing.overlap_size(left, right, least) == scan(left, right, least)
    assert packing.overlap_size("a" * 200_000 + "b", "a" * 200_001, 40) == 0


def test_long_overlaps_are_not_repeated(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    rows = [(0, [words[:9000], words[2000:], "other"]), (1, [None, "a", ""]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    got = {r["id"]: r["text"] for r in df.select("id", packing.merge_overlapping(F.col("texts")).alias("text")).collect()}
    assert got == {0: words + "\nother", 1: "a\n", 2: None, 3: ""}
