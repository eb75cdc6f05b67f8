"""Operators against plain loops over random inputs, and small cases of what no query calls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunking, entities, evidence, locators, packing, ranking, retrieval, selections
from quillstone.plans.search import DenseIndexer, Fuser, HybridRetriever, LexicalIndexer


def test_packs_with_overlap_equal_a_greedy_loop(spark):
    r = random.Random(2)
    # pieces of one letter and more: sizes are plain sums with a newline between
    cases = [["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 10))] for _ in range(80)]

    def running(held):
        size = 0
        for x in held:
            size += (1 if size else 0) + len(x)
        return size

    df = spark.createDataFrame(list(enumerate(cases)), "i int, units array<string>")
    got = {x["i"]: x["p"] for x in df.select("i", packing.pack_texts(F.col("units"), 20, 0).alias("p")).collect()}
    for i, units in enumerate(cases):
        plain, held = [], []
        for u in units:
            if held and running(held) + 1 + len(u) > 20:
                plain.append("\n".join(held))
                held = []
            held.append(u)
        assert got[i] == plain + (["\n".join(held)] if held else [])
    for row in df.select("i", packing.pack_texts(F.col("units"), 20, 6).alias("p")).collect():
        units, packs = cases[row["i"]], row["p"]
        # every unit is there in order, and a pack begins with trailing units of the last one that fit the overlap, one at least
        flat = []
        for n, p in enumerate(packs):
            own = p.split("\n")
            if n:
                before = packs[n - 1].split("\n")
                shared = next(k for k in range(len(own), 0, -1) if before[-k:] == own[:k] and flat + own[k:] == units[: len(flat) + len(own) - k])
                assert shared >= 1 and (shared == 1 or sum(map(len, own[:shared])) <= 6)
                own = own[shared:]
            flat += own
        assert flat == units


def test_greedy_alignment_equals_a_loop(spark):
    r = random.Random(3)
    tables, captions, want = [], [], set()
    for p in range(120):
        a = sorted(r.randint(1, 6) for _ in range(r.randint(0, 5)))
        b = sorted(r.randint(1, 6) for _ in range(r.randint(0, 5)))
        if r.random() < 0.3:
            b = list(a)
        tables += [(p, i, page) for i, page in enumerate(a)]
        captions += [(p, i, f"T{i}", page) for i, page in enumerate(b)]
        if all(a.count(x) == b.count(x) for x in {*a, *b}):
            for x in set(a):
                want |= {(p, i, f"T{j}", "page") for i, j in zip([i for i, y in enumerate(a) if y == x], [j for j, y in enumerate(b) if y == x])}
        elif len(a) == len(b):
            want |= {(p, i, f"T{i}", "total") for i in range(len(a))}
        else:
            i = j = 0
            while i < len(a) and j < len(b):
                if abs(a[i] - b[j]) <= 1:
                    want.add((p, i, f"T{j}", "greedy"))
                    i, j = i + 1, j + 1
                elif a[i] < b[j]:
                    i += 1
                else:
                    j += 1
    t = spark.createDataFrame(tables, "paper_id int, pos int, page int")
    c = spark.createDataFrame(captions + [(p, 100 + i, label.lower(), page) for p, i, label, page in captions[::3]], "paper_id int, pos int, label string, page int")
    got = {tuple(x) for x in locators.align_tables(t, locators.first_captions(c)).select("paper_id", "table_pos", "label", "mode").collect()}
    assert got == want


def test_layout_chunks_equal_a_block_loop(spark):
    r = random.Random(4)
    rows, want = [], set()
    for p in range(40):
        section, last, page, flow, flow_page, n = None, None, 0, [], None, {"c": 0, "eq": 0, "tab": 0, "fig": 0}
        found = []

        def close():
            if flow:
                found.append((flow[0][0], "text_span", flow_page + 1, section_of, "\n".join(x for _, x in flow), None))
                flow.clear()

        section_of = None
        for pos in range(r.randint(1, 14)):
            kind = r.choice(["text", "text", "text", "list", "equation", "table", "image", "footer", "heading"])
            page += r.random() < 0.2
            text, level, items, caption, body = None, None, None, None, None
            if kind == "heading":
                text, level = f"H{pos}", 1
                close()
                section = text
                rows.append((p, pos, "text", page, text, level, items, caption, body))
                flow_page = None
                continue
            if kind == "text":
                text = r.choice([f"words {pos}", ""])
            elif kind == "list":
                items = [f"a{pos}", " ", f"b{pos} "]
            elif kind == "equation":
                text = r.choice([f"x = {pos} \\tag{{{pos}}}", f"y = {pos}", f"z = 1 ({pos})"])
            elif kind == "table":
                caption = r.choice([[f"Table {pos}: T"], None])
                body = "<table><tr><td>u</td></tr></table>"
            elif kind == "image":
                caption = r.choice([[f"Fig. {pos} shows"], None])
            rows.append((p, pos, kind, page, text, level, items, caption, body))
            if kind in ("text", "list", "equation"):
                own = f"a{pos}\nb{pos}" if kind == "list" else (text or "").strip()
                if flow_page != page:
                    close()
                    flow_page = page
                section_of = section
                if kind == "equation":
                    tag = re.search(r"\\tag\{(.*?)\}|\(([0-9]+)\)$", text)
                    if tag:
                        found.append((pos, "equation_algorithm", page + 1, section, "\n".join(x for x in (last, own) if x), tag.group(1) or tag.group(2)))
                if own:
                    flow.append((pos, own))
                if kind == "text" and own:
                    last = own
            elif kind == "table":
                head = caption[0] if caption else ""
                found.append((pos, "table", page + 1, section, (head + "\n" if head else "") + "| u |\n| --- |", f"Table {pos}" if caption else None))
            elif kind == "image" and caption:
                found.append((pos, "figure", page + 1, section, caption[0], f"Figure {pos}"))
        close()
        prefix = {"text_span": "c", "equation_algorithm": "eq", "table": "tab", "figure": "fig"}
        for pos, kind, at, sec, text, ident in sorted(found, key=lambda x: x[0]):
            n[prefix[kind]] += 1
            want.add((f"{p}#{prefix[kind]}{n[prefix[kind]]:04d}", kind, at, sec, text, ident))
    schema = "paper_id int, pos int, type string, page_idx int, text string, text_level int, list_items array<string>, caption array<string>, table_body string"
    none = F.lit(None).cast("string")
    blocks = spark.createDataFrame(rows, schema).withColumns({"footnote": F.lit(None).cast("array<string>"), "content": none, "img_path": none})
    got = {tuple(x) for x in chunking.layout_chunks(blocks).select("chunk_id", "chunk_type", "page", "section", "text", "object_id").collect()}
    assert got == want


def test_rendered_chunks(spark):
    blocks = [("p", 0, "Text", "<p>one <b>two</b></p>", 0), ("p", 1, "PageHeader", "<p>x</p>", 0), ("p", 2, "Table", "<table><tr><td>a</td></tr></table>", 1), ("p", 3, "Text", "<p> </p>", 1), ("p", 4, "Code", "<pre>c</pre>", 2), ("p", 5, "ListGroup", "<li>l</li>", 2)]
    rows = chunking.rendered_chunks(spark.createDataFrame(blocks, "paper_id string, pos int, block_type string, html string, page int")).collect()
    assert sorted((r["chunk_id"], r["chunk_type"], r["page"], r["text"]) for r in rows) == [("p#c0001", "text_span", 1, "one two"), ("p#c0002", "text_span", 3, "l"), ("p#eq0001", "equation_algorithm", 3, "c"), ("p#tab0001", "table", 2, "a")]


def test_own_names_of_a_group_equal_plain_counts(spark):
    r = random.Random(5)
    pool = ["NetX", "AbC", "GPT", "Word", "lower", "Q2", "DeepSee", "XYZ-1", "toolongname9"]
    docs = [(g, d, " ".join(r.choice(pool[: 4 + d % 6]) for _ in range(60))) for g in range(3) for d in range(4)]
    got = {(x["group_id"], x["doc_id"], x["place"]): (x["token"], x["n"]) for x in entities.alias_tokens(spark.createDataFrame(docs, "group_id int, doc_id int, text string")).collect()}
    counts = {}
    for g, d, text in docs:
        own = counts.setdefault(g, {}).setdefault(d, {})
        for w in re.findall(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9-]{1,7}(?![A-Za-z0-9-])", text):
            if re.search("[A-Z]", w) and not re.fullmatch("[A-Z][a-z]+", w) and w.upper() not in entities.STOP:
                own[w] = own.get(w, 0) + 1
    want = {}
    for g, by_doc in counts.items():
        for d, own in by_doc.items():
            kept = [(w, n) for w, n in own.items() if n >= 8 and sum(o.get(w, 0) >= 3 for e, o in by_doc.items() if e != d) < 2]
            for place, (w, n) in enumerate(sorted(kept, key=lambda x: (-x[1], x[0]))[:5], 1):
                want[g, d, place] = (w, n)
    assert got == want


def test_hub_excerpts(spark):
    chunks = spark.createDataFrame([(1, 7, "a", "text_span", "x" * 700 + " NetX and Smith " + "y" * 700), (1, 7, "b", "table", "NetX only"), (1, 7, "c", "text_span", "NetX"), (1, 8, "d", "text_span", "none"), (1, 9, "e", "table", "Smith 2020")], "group_id int, doc_id int, chunk_id string, chunk_type string, text string")
    rows = entities.hub_excerpts(chunks, spark.createDataFrame([(1, "NetX"), (1, "Smith")], "group_id int, term string"), per_hub=2).orderBy("place").collect()
    assert [(r["doc_id"], r["chunk_id"], r["score"]) for r in rows] == [(7, "a", 20), (7, "b", 15), (9, "e", 15)]
    assert "NetX and Smith" in rows[0]["excerpt"] and len(rows[0]["excerpt"]) == 600


def test_reference_region_goes_on_through_dense_chunks(spark):
    dense = "A. B, 2020. arXiv " * 8
    chunks = [(1, i, kind, text, region) for i, (kind, text, region) in enumerate([("text_span", "intro", False), ("text_span", "refs", True), ("table", dense, False), ("text_span", dense, False), ("text_span", "thin, 2020.", False), ("text_span", dense, False)])]
    chunks += [(2, 0, "text_span", dense, False), (3, 0, "text_span", "refs", True)] + [(3, i, "text_span", dense, False) for i in range(1, 9)]
    rows = evidence.extended_region(spark.createDataFrame(chunks, "doc_id int, pos int, source_type string, text string, in_region boolean")).collect()
    assert sorted((r["doc_id"], r["pos"]) for r in rows) == [(1, 1), (1, 3)] + [(3, i) for i in range(7)]


def test_zero_overlap_and_caching_shells(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in x], "k int") for x in ((1, 2), (2, 3), (9,)))
    assert selections.overlaps(a, b, "k") and not selections.overlaps(a, c, "k")


def test_repeated_rows_of_a_query_don_t_count_twice(spark):
    chunks = spark.createDataFrame([(1, 1, "red apple"), (2, 2, "green pear"), (3, 3, "apple pear")], "chunk_id long, doc_id long, text string")
    index = retrieval.BM25Index.build(chunks)
    once = spark.createDataFrame([(1, "apple pie")], "query_id long, text string")
    assert sorted(index.search(once, 5).collect()) == sorted(index.search(once.union(once), 5).collect())


def test_filters_restrict_before_the_cut(spark):
    chunks = spark.createDataFrame([(i, i, "apple " * (20 - i) + "pear") for i in range(20)], "chunk_id long, doc_id long, text string")
    retriever = HybridRetriever([LexicalIndexer().build(chunks), DenseIndexer().build(chunks)], Fuser(), 3)
    ask = spark.createDataFrame([(1, "apple")], "query_id long, text string")
    within = chunks.where("chunk_id >= 15").select("chunk_id")
    got = {r["chunk_id"] for r in retriever.retrieve(ask, 5, within).collect()}
    assert got and got <= set(range(15, 20))
    score = {r["chunk_id"]: r["score"] for r in LexicalIndexer().build(chunks).search(ask, 20).collect()}
    inside = {r["chunk_id"]: r["score"] for r in LexicalIndexer().build(chunks).search(ask, 20, within).collect()}
    assert inside == {k: v for k, v in score.items() if k >= 15}


def test_running_best_equals_a_whole_sort(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    best = retrieval.Best(7, 3)
    best.room = 50
    every = []
    for _ in range(30):
        n = int(rng.integers(0, 40))
        q, s, key = rng.integers(0, 7, n), np.round(rng.random(n), 1), rng.integers(0, 1000, n)
        best.add(q, s, key, key * 2)
        every += list(zip(q.tolist(), (-s).tolist(), key.tolist()))
    got = sorted(zip(*(x.tolist() for x in best.rows())))
    want = []
    for q in range(7):
        want += [(q, -s, k, 2 * k) for _, s, k in sorted(x for x in every if x[0] == q)[:3]]
    assert got == sorted(want)


def test_growth_threshold(spark):
    rounds = spark.createDataFrame([(1, 0, 100), (1, 1, 104), (1, 2, 104)], "query_id int, round int, total int")
    flags = lambda t: [r["stagnant"] for r in ranking.growth(rounds, threshold=t).orderBy("round").collect()]
    assert flags(0.0) == [0, 0, 1] and flags(0.05) == [0, 1, 2]


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        ranking.family_cutoff(spark.createDataFrame([(1, 1)], "query_id int, rank int"), spark.createDataFrame([(1, "x")], "query_id int, task_family string"), "other")


def test_lists_merge_in_order(spark):
    lists = [spark.createDataFrame(rows, "query_id int, doc_id string, rank int") for rows in ([(1, "b", 1), (1, "a", 2)], [(1, "a", 1), (1, "c", 2), (2, "z", 1)], [(1, "d", 1), (1, "b", 2)])]
    rows = ranking.merge_lists(lists, ["query_id", "doc_id"], limit=3).orderBy("query_id", "merged_rank").collect()
    assert [(r["query_id"], r["doc_id"], r["source_no"]) for r in rows] == [(1, "b", 0), (1, "a", 0), (1, "c", 1), (2, "z", 1)]
    with pytest.raises(ValueError, match="repeated"):
        ranking.merge_lists(lists, ["query_id", "doc_id"], strict=True)
    assert ranking.merge_lists(lists[:1], ["query_id", "doc_id"], strict=True).count() == 2


def test_lookup_requests(spark):
    cases = {
        "How many references include Smith as an author?": ("reference_count", None, False, "Smith"),
        "How many references are there?": None,
        "What is the last cited reference?": ("reference", None, True, None),
        "Who wrote the 12th reference?": ("reference", 12, False, None),
        "title of the third listed reference": ("reference", 3, False, None),
        "see Reference number [7]": ("reference", 7, False, None),
        "What does Eq. (4) state?": ("equation", 4, False, None),
        "nothing of the sort": None,
        None: None,
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string")
    got = {r["i"]: tuple(r["x"]) if r["x"] else None for r in df.select("i", evidence.lookup_request(F.col("q")).alias("x")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_surnames_are_counted_in_the_reference_region(spark):
    entries = "[1] Smith, A. [2] Jones, B. [3] Smithson, C."
    chunks = [(1, 0, "metadata", "References", "Smith"), (1, 1, "text_span", "Intro", "Smith " + entries), (1, 2, "text_span", "References", entries), (1, 3, "text_span", "x", "D. Smith, 2020. arXiv " * 8), (2, 0, "text_span", None, entries), (2, 1, "text_span", None, "Smith")]
    rows = spark.createDataFrame(chunks, "doc_id int, pos int, source_type string, section string, text string")
    region = {(r["doc_id"], r["pos"]) for r in evidence.reference_region(rows).where("in_region").collect()}
    assert region == {(1, 2), (2, 0)}
    names = spark.createDataFrame([(1, "Smith"), (2, "Smiths")], "doc_id int, surname string")
    assert [(r["doc_id"], r["pos"], r["place"]) for r in evidence.surname_chunks(rows, names).orderBy("pos").collect()] == [(1, 2, 1), (1, 3, 2)]


def test_looked_up_snippets_fan_out(spark):
    found = spark.sql("SELECT 1 AS query_id, 'p' AS doc_id, 'citation_context' AS source_type, 'aaaabbbbcccc' AS content, array(3, 4, 5) AS pages, 'cccc' AS snippet UNION ALL SELECT 2, 'p', 'x', 'a', array(), 'a'")
    assert sorted((r["query_id"], r["page"]) for r in evidence.lookup_evidence(found).collect()) == [(1, 3), (1, 5)]


def test_candidate_pages_put_figure_evidence_first(spark):
    papers = spark.createDataFrame([(1, "p", 0), (1, "q", 1)], "query_id int, doc_id string, order int")
    items = spark.createDataFrame([(1, 0, "p", "table", " 4 "), (1, 1, "q", "figure", "2"), (1, 2, "z", "figure", "9"), (1, 3, "p", "figure", "x"), (1, 4, "p", "text_span", "0")], "query_id int, pos int, doc_id string, source_type string, page string")
    chunks = spark.createDataFrame([("q", 0, "figure", '{"page": 2, "figure_id": "Figure 1"}', ["1"]), ("q", 1, "figure", "broken", ["7"]), ("p", 0, "figure", None, []), ("p", 1, "figure", '{"page": "5"}', None), ("p", 2, "table", None, ["1"])], "doc_id string, pos int, source_type string, locator_json string, page_numbers array<string>")
    figures = evidence.figure_rows(chunks)
    assert {(r["doc_id"], r["figure_id"], r["page"]) for r in figures.collect()} == {("p", None, 5), ("q", None, 7), ("q", "Figure 1", 2)}
    got = [(r["doc_id"], r["page"]) for r in evidence.candidate_pages(papers, items, figures, 4).orderBy("place").collect()]
    assert got == [("q", 2), ("p", 4), ("p", 5), ("q", 7)]


def test_facts_of_papers(spark):
    chunks = [(1, 1, "metadata", None, "Title: T\nAuthors: Ann B. Smith, Bo\nAbstract: Deep\nnets"), (1, 2, "metadata", None, "Authors: Other"), (2, 0, "text_span", "1 Abstract", "words"), (2, 1, "metadata", None, "Title: U\nAbstract: ")]
    rows = {r["doc_id"]: (r["surname"], r["abstract"]) for r in evidence.paper_facts(spark.createDataFrame(chunks, "doc_id int, pos int, source_type string, section string, text string")).collect()}
    assert rows == {1: ("Smith", "Deep\nnets"), 2: ("", "words")}


def test_listing_for_a_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "q", None, None, None, 1, "q1", "table", None, "tt"), (1, 1, "p", "T", "ACL", 2020, 2, "p2", "text_span", 3, "long text"), (1, 1, "p", "T", "ACL", 2020, 1, "p1", None, 1, None)], "query_id int, doc_rank int, doc_id string, title string, venue string, year int, chunk_rank int, chunk_id string, chunk_type string, page int, text string")
    text = evidence.result_lines(hits, 4).collect()[0]["listing"]
    assert text == "[p] T (ACL 2020)\n  - p1 (type=, page=1)\n    \n  - p2 (type=text_span, page=3)\n    long\n\n[q]  ( )\n  - q1 (type=table)\n    tt"


def test_experiments_side_by_side_and_scan_statistics(spark):
    from quillstone.operators import logs

    runs = spark.sql("SELECT * FROM VALUES (0, map('k', '10', 'w', '1'), map('f1', 0.5D)), (1, map('k', '20', 'w', '1'), map('f1', 0.7D)), (2, map('k', '10', 'w', '1', 'z', '5'), map('mc', 1.0D)) AS t(run_no, params, metrics)")
    table = logs.experiment_table(runs, ["f1", "mc"])
    assert table.columns == ["run_no", "param_k", "param_z", "f1", "mc"]
    assert sorted(map(tuple, table.collect()), key=str) == [(0, "10", None, 0.5, None), (1, "20", None, 0.7, None), (2, "10", "5", None, 1.0)]
    scans = spark.sql("SELECT * FROM VALUES ('a', 0, 2, 1, array('x')), ('a', 1, 3, 0, array('y', 'z')), ('b', 0, 1, 1, array()) AS t(kind, pos, n, bad, notes)")
    got = {r["kind"]: (r["n"], r["bad"], r["n_scans"], r["notes"]) for r in logs.scan_statistics(scans, ["kind"], ["n", "bad"], shown=2).collect()}
    assert got == {"a": (5, 1, 2, ["x", "y"]), "b": (1, 1, 1, None)}


def test_inverted_index_reaches_exact_search(spark, tmp_path):
    import numpy as np

    from quillstone.operators.ann import InvertedIndex

    rng = np.random.default_rng(3)
    centers = rng.standard_normal((30, 32))
    rows = [(i, i, [float(x) for x in centers[i % 30] + 0.4 * rng.standard_normal(32)]) for i in range(3000)] + [(9000, 1, [0.0] * 32), (9001, 1, None), (9002, 1, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, doc_id long, vector array<double>").repartition(3)
    index = InvertedIndex.build(corpus, f"{tmp_path}/index", sample=1000)
    assert index.rows.select("chunk_id").distinct().count() == index.rows.count() == 3000 and len(index.centroids) == 54
    queries = corpus.where("chunk_id % 50 = 0 and chunk_id < 3000").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.knn(corpus, queries, 10, skip_self=True).collect()}
    hits = index.search(queries, 10, probes=12, skip_self=True)
    found = {(r["query_id"], r["chunk_id"]) for r in hits.collect()}
    assert len(exact & found) >= 0.9 * len(exact) and hits.groupBy("query_id").count().where("count > 10").isEmpty()
    whole = {(r["query_id"], r["chunk_id"]) for r in index.search(queries, 10, probes=99, skip_self=True).collect()}
    assert whole == exact
    one = index.search(queries.limit(1), 5, probes=1)
    assert "PartitionFilters: [list_no" in one._jdf.queryExecution().toString() or "list_no" in one._jdf.queryExecution().toString()


def test_inverted_index_on_the_tables(spark, tmp_path):
    import os

    from quillstone.operators.ann import InvertedIndex

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    corpus = spark.read.parquet(path).select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = corpus.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.knn(corpus, queries, 10, skip_self=True).collect()}
    index = InvertedIndex.build(corpus, f"{tmp_path}/index")
    found = {(r["query_id"], r["chunk_id"]) for r in index.search(queries, 10, probes=30, skip_self=True).collect()}
    print(len(exact & found) / len(exact), len(index.centroids))
    assert len(exact & found) >= 0.9 * len(exact)
