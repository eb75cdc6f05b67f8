import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bytesops as B
from quillstone.llm import order_minhash as O
from quillstone.llm.edit import banded_distance, cut_points, histogram, similar, split_histograms
from quillstone.llm.graph import components


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.integers(0, 4), max_size=24)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 30))
def test_band_equals_full_alignment(a, b, limit):
    want = levenshtein(a, b)
    got = banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit)
    assert got == want if want <= limit else got > limit


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=60), st.lists(st.integers(0, 200), min_size=1, max_size=60))
def test_bounds_never_exceed_distance(a, b):
    a, b = np.array(a, np.uint32), np.array(b, np.uint32)
    d = levenshtein(a.tolist(), b.tolist())
    assert np.abs(histogram(a) - histogram(b)).sum() <= 2 * d
    cuts = cut_points(max(len(a), len(b)))
    for c in range(len(cuts)):
        assert np.abs(split_histograms(a, cuts)[c] - split_histograms(b, cuts)[c]).sum() <= 3 * d


def word_ids(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return B.words(raw, np.array([0, len(raw)]))[3]


def brute(rows, least=0.8):
    """Classes of the graph of equal texts and of all pairs that align, sketches aside."""
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    w = {i: word_ids(t or "") for i, t in rows}
    for n, (i, s) in enumerate(rows):
        for j, t in rows[n + 1 :]:
            if (s or "") == (t or "") or (len(w[i]) and len(w[j]) and similar(w[i], w[j], least)):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{n}" for n in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        for k in range(r.randint(1, 6)):
            copy = [x if k == 0 or r.random() > 0.04 else r.choice(vocabulary) for x in base]
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(r.choice(vocabulary) for _ in range(55))
    rows += [(n + i, shared + " " + " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(25)]
    n += 25
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "one"), (n + 4, "..."), (n + 5, "two words"), (n + 6, "x " * 3000)]


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in O.near_duplicates(docs, chunk=7).collect()}
    assert got == brute(rows)


def test_stage_keeps_first_and_columns(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(5, text, "a"), (3, text.replace("t7 ", "u7 "), "b"), (9, "quite another text than those", "c"), (None, text, "d"), (9, "quite another text than those", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    out = O.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 9]
    assert O.deduplicate(docs.limit(0)).count() == 0


def test_order_matters_to_sketches():
    def keys(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, rows, hashes = B.words(raw, np.array([0, len(raw)]))
        s, r, _ = B.shingles(hashes, rows, 1, 5)
        return O.sketches(s, r, 1, 32, 2)[1][0]

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    same = (keys(a + " " + b) == keys(b + " " + a)).sum()
    assert (keys(a + " " + b) == keys(a + " " + b)).all() and same < 24


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 500: 500}
    assert components(df.limit(0)).count() == 0


def edited(r, base, share):
    """base with exactly that share of its words substituted, dropped or preceded by another, rounded down."""
    out = list(base)
    for n, at in enumerate(sorted(r.sample(range(len(base)), int(len(base) * share + 1e-9)), reverse=True)):
        kind = r.choice("sssdi")
        out[at : at + 1] = [] if kind == "d" else [f"e{r.getrandbits(60)}"] if kind == "s" else [f"e{r.getrandbits(60)}", out[at]]
    return " ".join(out)


def test_recall_at_the_threshold(spark):
    """Isolated pairs with 10 to 20 % of their words edited, against the alignment of every pair."""
    r = random.Random(8)
    rows, pairs = [], []
    for size in (5, 8, 10, 13, 16, 20, 31, 40, 100, 300):
        for share in (0.1, 0.15, 0.17, 0.19, 0.2):
            for _ in range(25):
                base = [f"b{r.getrandbits(60)}" for _ in range(size)]
                a, b = len(rows), len(rows) + 1
                rows += [(a, " ".join(base)), (b, edited(r, base, share))]
                if rows[a][1] == rows[b][1] or similar(word_ids(rows[a][1]), word_ids(rows[b][1]), 0.8):
                    pairs.append((size, share, a, b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in O.near_duplicates(docs).collect()}
    missed = [(size, share) for size, share, a, b in pairs if got[b] != a]
    print(f"{len(pairs) - len(missed)} of {len(pairs)} found; missed {missed}")
    assert len(pairs) > 1000 and len(missed) <= 0.01 * len(pairs)
    assert all(got[a] == a for _, _, a, _ in pairs)


def test_short_text_with_a_middle_word_changed(spark):
    words = "one two three four five six seven eight nine ten".split()
    docs = spark.createDataFrame([(i, " ".join(words[:i] + ["other"] + words[i + 1 :])) for i in range(10)] + [(10, " ".join(words))], "doc_id long, text string")
    assert {x["class_id"] for x in O.near_duplicates(docs).collect()} == {0}


def test_rows_of_one_doc_id(spark):
    text, other = " ".join(f"t{i}" for i in range(50)), " ".join(f"o{i}" for i in range(50))
    near = text.replace("t7 ", "u7 ")
    rows = [(1, text, "a"), (1, other, "b"), (2, near, "c"), (3, other, "d"), (3, other, "d"), (4, None, "e"), (5, "", "f"), (None, text, "g"), (7, text, "h")] + [(9, "own " + other[:90], "i")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in O.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (4, False), 7: (1, False), 9: (9, True)}
    kept = O.deduplicate(docs)
    assert kept.columns == docs.columns
    tags = sorted(r["digest"] for r in kept.collect())
    assert tags == ["a", "b", "e", "g", "i"]
    assert sorted(r["digest"] for r in O.deduplicate(docs.where("doc_id in (3, 9)")).collect()) == ["d", "i"]


def test_one_giant_class_and_nothing_left_behind(spark):
    import os

    text = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(text[:20] + [f"v{i}"] + text[20:])) for i in range(300)] + [(1000 + i, f"single {i} words of its own {i * 7}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/quillstone"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = {r["doc_id"]: r["class_id"] for r in O.near_duplicates(docs, chunk=50).collect()}
    assert got == {i: 0 if i < 300 else i for i, _ in rows}
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"near"}


def test_links_are_written_to_few_files(spark, monkeypatch):
    """The links of many tasks are a few rows each: as many files would be written and read again."""
    inputs = []
    find = O.components

    def recorded(edges, scratch):
        inputs.append((edges.rdd.getNumPartitions(), edges.count()))
        return find(edges, scratch)

    monkeypatch.setattr(O, "components", recorded)
    rows = corpus()
    small = {"shuffle.partitions": "40", "autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.coalescePartitions.minPartitionSize": "1k", "adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        got = {r["doc_id"]: r["class_id"] for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), chunk=7).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert got == brute(rows)
    assert len(inputs) == 2 and inputs[0][1] > 10
    assert all(parts == 1 for parts, _ in inputs), inputs
