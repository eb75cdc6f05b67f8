import re

from quillstone.llm import templates as T

ITEM = "A train leaves the old station with 120 km to go and Anna pays 45 dollars for 2 tickets. How long will the whole journey take if the speed stays at 60 kmh?"
FILLER = "the river runs down to a small harbour where boats wait for the tide and nobody counts the days. "


def plain(text):
    return re.findall(r"[0-9]+|[a-z]+", text.lower())


def test_kinds():
    import numpy as np

    raw = np.frombuffer("We saw Anna pay 1,200.50 dollars, 5kg. Bob left\nTom ran.".encode(), np.uint8)
    starts, ends, _, kind, _ = T.tokens(raw, np.array([0, len(raw)]))
    got = {raw[a:b].tobytes().decode(): int(k) for a, b, k in zip(starts, ends, kind)}
    assert got["Anna"] == T.NAME and got["1,200.50"] == T.NUM and got["dollars"] == T.UNIT
    assert got["5"] == T.NUM and got["kg"] == T.UNIT
    assert got["Bob"] == got["Tom"] == got["We"] == T.LITERAL


def test_copies_and_new_parameters_are_found(spark):
    again = ITEM.replace("120", "350").replace("Anna", "Maria").replace("45 dollars", "80 euros").replace("60", "75")
    broken = ITEM.replace("Anna pays", "Anna pays").replace(ITEM[:40], ITEM[:40].upper()[:0] + "Nothing of the sort was said here at all")
    half = " ".join(ITEM.split()[: len(ITEM.split()) // 2])
    docs = [(1, FILLER * 3 + ITEM + " " + FILLER), (2, FILLER + "and so " + again + FILLER), (3, FILLER * 9), (4, half + ". " + FILLER), (5, None), (6, ""), (7, ITEM), (8, broken if len(plain(broken)) < 10 else FILLER), (None, ITEM)]
    items = [(0, ITEM), (1, "too short"), (2, None), (3, ""), (4, "12 13 14 15 16 17")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as similarity")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in T.contaminated(d, b).collect()}
    assert set(got) == {(1, 0), (2, 0), (7, 0), (None, 0)}
    assert got[1, 0]["n_changed"] == 0 and got[1, 0]["similarity"] == 1.0
    assert got[2, 0]["changed"] == {"120": "350", "anna": "maria", "45": "80", "dollars": "euros", "60": "75"}
    kept = T.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert T.contaminated(d.limit(0), b).count() == 0 and T.contaminated(d, b.limit(0)).count() == 0


def test_inconsistent_slots_are_rejected():
    item = "First Anna walks 5 km to the mill and then Anna walks 5 km back to the house by the lake."
    good = item.replace("Anna", "Ruth").replace("5", "8")
    bad = item.replace("Anna", "Ruth", 1).replace("5", "8", 1)
    assert T.aligned(item, good, 5, 0.8)["similarity"] == 1.0
    assert T.aligned(item, bad, 5, 0.8) is None


def test_blocks_of_windows_agree(spark):
    docs = spark.createDataFrame([(i, FILLER + (ITEM if i % 3 == 0 else "") + FILLER) for i in range(9)], "doc_id long, text string")
    b = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, FILLER)], "item_id long, text string")
    one = sorted(tuple(r)[:5] for r in T.contaminated(docs, b).collect())
    many = sorted(tuple(r)[:5] for r in T.contaminated(docs, b, block=5).collect())
    assert one == many and len(one) == 3 + 9


def test_verbatim_passages_equal_containment(spark):
    """On the stand-in tables every verbatim passage is found and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in items.collect() if b["text"] in d["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in T.contaminated(docs, items).collect()} == want


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in T.contaminated(d, b).collect()}


def test_names_that_open_sentences(spark):
    item = "Tom has 3 red apples in a basket. Tom buys 4 more of them at the shop. Then he gives half of all to Anna."
    other = item.replace("Tom", "Ann").replace("3", "9").replace("4", "2").replace("Anna", "Ruth")
    mixed = "we know that " + other.replace("basket. Ann", "basket; Ann")
    clash = "Ann has 9 apples. Bob buys 2 more."
    short = "Tom has 3 apples. Tom buys 4 more."
    got = found(spark, [FILLER + other + " " + FILLER, FILLER + mixed, clash, "Ann has 9 apples. Ann buys 2 more.", item, "He said so. " + item], [item, short])
    assert {k for k in got if k[1] == 0} == {(0, 0), (1, 0), (4, 0), (5, 0)}
    assert {k for k in got if k[1] == 1} == {(3, 1)}
    assert got[0, 0]["changed"] == {"tom": "ann", "3": "9", "4": "2", "anna": "ruth"} and got[1, 0]["similarity"] == 1.0


def test_items_without_telling_windows_match_verbatim(spark):
    sums = "What is 48 + 27 - 5 * 3?"
    table = " ".join(f"{i * 7} {'km' if i % 2 else 'kg'}" for i in range(60))
    mean = "5 km 5 km 5 km 5 km"
    items = [sums, table, mean, "12 Oslo", "...", "", None]
    docs = [FILLER + sums + " " + FILLER, FILLER + table + " " + FILLER, sums.replace("27", "28"), table[:-7], "it was 5 km 5 km 5 km 5 km.", "only 5 km 5 km 5 km 6 km", "see 12 Oslo, 4", "see 112 Oslo", "", None]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (4, 2), (6, 3)}
    assert got[0, 0]["first_word"] == 19 and got[0, 0]["last_word"] == 25 and got[0, 0]["n_changed"] == 0


def test_edited_and_partly_leaked_items_are_found(spark):
    rest = "Every clerk then writes each name into a green book, folds the map along its old lines and sends a boy to fetch more ink from the shop behind the church before the bell rings."
    long = ITEM + " " + rest
    edited = ITEM.replace("station", "depot").replace("whole", "entire").replace("stays", "holds")
    cut_out = ITEM.replace("old ", "").replace("will the", "will then the")
    part = FILLER + rest + " " + FILLER
    half = " ".join(ITEM.split()[: len(ITEM.split()) // 2])
    got = found(spark, [FILLER + edited + " " + FILLER, cut_out, part, half + ". " + FILLER, FILLER * 4], [ITEM, long])
    assert {k for k in got if k[1] == 0} == {(0, 0), (1, 0)} and (2, 1) in got and (3, 1) not in got
    assert got[0, 0]["similarity"] > 0.85


def brute(text, item, least=0.8):
    """The item slid over the text word by word: enough words kept, one value for each of the item's values."""

    def read(s):
        out = []
        for m in re.finditer(r"[0-9]+|[A-Za-z]+", s):
            w = m.group()
            kind = "n" if w.isdigit() else "u" if out and out[-1][0] == "n" and w in T.UNITS else "p" if w[0].isupper() else "w"
            out.append((kind, w.lower()))
        return out

    a, b = read(item), read(text)
    for at in range(len(b) - len(a) + 1):
        values, kept, sound = {}, 0, True
        for (k, x), (j, y) in zip(a, b[at:]):
            if k == j and (k != "w" or x == y):
                kept += 1
                sound &= k == "w" or values.setdefault((k, x), y) == y
        if sound and kept >= least * len(a):
            return True
    return False


def test_reparameterised_items_equal_brute_force(spark):
    import random

    r = random.Random(4)
    pool = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    names, units = ["Anna", "Ruth", "Boris", "Clara"], ["km", "kg", "hours", "tagen", "horas"]

    def sentence(n):
        out = [r.choice(pool) for _ in range(n)]
        for i in range(2, n, 4):
            out[i] = r.choice([str(r.randint(2, 99)), f"{r.randint(2, 99)} {r.choice(units)}", r.choice(names)])
        return out

    def again(words, rename, edits):
        values, out = {}, []
        for w in " ".join(words).split():
            if rename and (w[0].isdigit() or w in names or w in units):
                choices = names if w in names else units if w in units else [str(x) for x in range(100, 999)]
                w = values.setdefault(w, r.choice(choices))
            out.append(w)
        for i in r.sample([i for i, w in enumerate(out) if w in pool], min(edits, sum(w in pool for w in out))):
            out[i] = r.choice(pool)
        return " ".join(out)

    items = [sentence(r.randint(18, 24)) for _ in range(25)]  # too short for the rule of words in a row
    docs = []
    for words in items:
        for rename, edits in ((0, 0), (1, 0), (1, 1), (0, 2), (1, 40), (0, 40)):
            docs.append(" ".join(sentence(30)) + " " + again(words, rename, edits) + " " + " ".join(sentence(20)))
        # one value of the item turned into two
        broken = again(words, 0, 0).split()
        spot = next((i for i, w in enumerate(broken) if broken.count(w) > 1 and w not in pool), None)
        if spot is not None:
            broken[spot] = {True: "Zoe", False: "kg" if broken[spot] != "kg" else "km"}[broken[spot] in names] if not broken[spot].isdigit() else "777"
            docs.append(" ".join(broken))
    texts = [" ".join(w) for w in items]
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(texts) if brute(d, t)}
    got = {k for k, v in found(spark, docs, texts).items() if v["similarity"] >= 0.8}
    assert got == want and len(want) >= 90


def test_rows_without_ids_and_rows_of_one_id_are_judged_by_their_text(spark):
    rows = [(None, ITEM, "a"), (None, FILLER, "b"), (None, None, "c"), (5, FILLER + ITEM, "d"), (5, FILLER, "e"), (6, ITEM, "f"), (6, ITEM, "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    b = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    kept = T.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r["digest"] for r in kept.collect()) == ["b", "c", "e"]
