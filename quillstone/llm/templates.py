"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers <NUM>, units after a number <UNIT>, capitalised words within a
sentence <NAME>, the rest lower-cased. A capitalised word that opens a sentence may be a name or a plain
word, so its windows stand in both forms on both sides. Windows of five tokens are hashed on both sides and joined on
the hash; windows with fewer than three literal words say nothing and are left out of both sides. A
document whose windows cover at least 0.4 of the words that a benchmark item's windows cover, or 16 of
them, is a candidate. It is contaminated if the alignment keeps 0.8 of the item's windows or of its
words (single words beside the aligned windows count too) with consistent slots, i.e. if each value of
the item's slots stands for one value of its kind in the document, or if it keeps 32 words of the item
in a row with consistent slots. A word that opens a sentence counts as a name first; if that
is inconsistent, as a plain word that is lost where it differs. Thus verbatim copies are found (each value stands for
itself) and so are questions asked again with other numbers, names or units.

Documents are scanned once for each block of at most BLOCK_WINDOWS benchmark windows, which go to
every task; only hits are shuffled, to the hash join that brings item and document together. Texts
are scanned whole, and every benchmark item counts, whatever the table's size.

Defined cases: null and empty texts hold no window; an item of fewer than five words, or one of fewer
than 64 without a telling window, is one window of all its words if three of them are literal. Every
other item without a telling window, of whatever length, is met by its own words in a row, numbers,
units and names as they are; an item without words matches nothing; repeated rows of either table count once; null ids give
rows with null ids; rows of one doc_id with different texts are judged each by its own text; empty tables
give an empty table. Two values of an item may become one value in a document (3 and 4 both turned to 5),
but one value never two.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import Scratch, cut_table

WINDOW, LITERALS, SIMILARITY = 5, 3, 0.8
BLOCK_WINDOWS = 2_000_000
#: Share of an item's covered words, or their number, that makes a candidate; words in a row that suffice.
FLOOR, FLOOR_WORDS, RUN = 0.4, 16, 32
#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ounce ounces "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "ml l liter liters litre litres gallon gallons cup cups "
    "hz khz mhz ghz w kw v a j kj n pa kpa mph kmh percent degrees degree "
    "usd eur gbp dollar dollars cent cents euro euros "
    "meile meilen zoll pfund tonne tonnen gramm kilogramm sekunde sekunden minuten stunde stunden tag tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "metre mille milles pouce pouces gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois an ans litre pourcent degr\u00e9 degr\u00e9s "
    "metro metros kil\u00f3metro kil\u00f3metros milla millas gramo gramos kilo kilos segundo segundos minuto minutos hora horas d\u00eda d\u00edas semana semanas mes meses a\u00f1o a\u00f1os litro litros grado grados d\u00f3lar d\u00f3lares"
).split()
NUM, UNIT, NAME, LITERAL = 1, 2, 3, 0
SLOT_HASH = B.mix(np.arange(4, dtype=np.uint64) + np.uint64(0x51_0000))
IS_END = np.zeros(256, bool)
IS_END[list(b".!?:;\n\r")] = True
_units = np.sort(np.array([B.hash_text(u) for u in UNITS], np.uint64))
_weights = B.mix(np.arange(64, dtype=np.uint64) + np.uint64(0x77_0000)) | np.uint64(1)


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, rows, kinds and literal hashes of the template tokens, and which capitalised literals open a sentence.

    A number takes points and commas between digits; letters after digits are a token of their own.
    """
    n = len(data)
    digit = B.IS_DIGIT[data]
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    word = B.IS_WORD[data] | inner
    numeric = digit | inner
    turn = np.zeros(n, bool)
    turn[1:] = numeric[1:] != numeric[:-1]
    starts, ends, rows = B.spans(word, offsets, turn & word)
    hashes = B.span_hash(B.prefix_hash(B.LOWER[data]), starts, ends)
    kind = np.zeros(len(starts), np.int8)
    if not len(starts):
        return starts, ends, rows, kind, hashes, np.zeros(0, bool)
    kind[numeric[starts]] = NUM
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    after_number = np.concatenate(([False], kind[:-1] == NUM)) & ~first
    at = np.minimum(np.searchsorted(_units, hashes), len(_units) - 1)
    kind[after_number & (_units[at] == hashes)] = UNIT
    lead = data[starts]
    second = data[np.minimum(starts + 1, n - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.concatenate(([0], np.cumsum(IS_END[data])))
    sentence_start = first | np.concatenate(([True], stops[starts[1:]] > stops[ends[:-1]]))
    capital &= kind == LITERAL
    kind[capital & ~sentence_start] = NAME
    return starts, ends, rows, kind, hashes, capital & sentence_start


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows, kinds and literal hashes of the template tokens."""
    return templates(data, offsets)[:5]


def windows(rows: np.ndarray, kind: np.ndarray, hashes: np.ndarray, opens: np.ndarray, n_rows: int, width: int, document: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and positions of the telling windows, in every reading of the words that open a sentence (name or
    plain word; beyond WINDOW tokens all read alike). In a document a window's first name may be a plain word too:
    where a passage begins, the capital may be a sentence's; and names count as literals, for the item's word may be one."""
    token = np.where(kind > 0, SLOT_HASH[kind], hashes)
    bounds = B.row_bounds(rows, n_rows)
    n = len(token)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - width + 1
    total = np.zeros(m, np.uint64)
    literal = np.zeros(m, np.int32)
    solid = (kind == LITERAL) | (kind == NAME) if document else kind == LITERAL
    for j in range(width):
        total += token[j : j + m] * _weights[j]
        literal += solid[j : j + m]
    keep = np.flatnonzero((rows[:m] == rows[width - 1 :]) & (literal >= LITERALS))
    sums, at = [total[keep]], [keep]
    turned = np.where(opens, SLOT_HASH[NAME], hashes) - token
    code = np.zeros(len(keep), np.uint64)
    for j in range(width):
        open_to = opens[keep + j] | ((kind[keep] == NAME) if document and j == 0 else False)
        code |= open_to.astype(np.uint64) << np.uint64(j)
    for c in np.unique(code[code > 0]).tolist():
        own = keep[code == c]
        part = c
        while part:
            sums.append(total[own] + sum(turned[own + j] * _weights[j] for j in range(width) if part >> j & 1))
            at.append(own)
            part = (part - 1) & c if width <= WINDOW else 0
    out, at = B.mix(np.concatenate(sums) + np.uint64(width)), np.concatenate(at)
    return out, rows[at], at - bounds[rows[at]]


def plain_windows(rows: np.ndarray, hashes: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and positions of all windows of words as they are."""
    m = max(0, len(hashes) - width + 1)
    total = np.zeros(m, np.uint64)
    for j in range(width):
        total += hashes[j : j + m] * _weights[j]
    keep = np.flatnonzero(rows[:m] == rows[width - 1 : width - 1 + m])
    return B.mix(total[keep] + np.uint64(len(_weights) + width)), rows[keep], keep - B.row_bounds(rows, n_rows)[rows[keep]]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, width, hash, pos, n) of every item's windows, n being the number of words
    that they cover; the width of windows of words as they are is negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            _, _, rows, kind, hashes, opens = templates(data, offsets)
            bounds = B.row_bounds(rows, batch.num_rows)
            out: dict[str, list] = defaultdict(list)
            for r in range(batch.num_rows):
                k, h, o = (x[bounds[r] : bounds[r + 1]] for x in (kind, hashes, opens))
                zero = np.zeros(len(k), np.int64)
                width = WINDOW
                got, _, pos = windows(zero, k, h, o, 1, width, False)
                if not len(got) and 0 < len(k) < len(_weights):
                    width = len(k)
                    got, _, pos = windows(zero, k, h, o, 1, width, False)
                if not len(got) and len(k):
                    width = -min(len(k), WINDOW)
                    got, _, pos = plain_windows(zero, h, 1, -width)
                out["row"] += [r] * len(got)
                out["width"] += [width] * len(got)
                out["hash"] += got.view(np.int64).tolist()
                out["pos"] += pos.tolist()
                out["n"] += [len(np.unique(pos[:, None] + np.arange(abs(width))))] * len(got)
            at = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), batch.column("text").take(at), *(pa.array(out[c], pa.int64()) for c in ("width", "hash", "pos", "n"))], ["item_id", "text", "width", "hash", "pos", "n"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, text string, width long, hash long, pos long, n long")


def document_hits(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, text, hits) of the documents that hold any of the wanted window hashes (sorted, by width)."""
    state = docs.sparkSession.sparkContext.broadcast(wanted)

    low = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tables of hash bits sift most windows before the search
        sieves = {width: np.zeros(1 << 20, bool) for width in state.value}
        for width, keys in state.value.items():
            sieves[width][keys & low] = True
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            for i, j in B.slices(offsets):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, rows, kind, hashes, opens = templates(part, offs)
                found: dict[int, set[int]] = defaultdict(set)
                for width, keys in state.value.items():
                    got, own, _ = windows(rows, kind, hashes, opens, j - i, width, True) if width > 0 else plain_windows(rows, hashes, j - i, -width)
                    maybe = np.flatnonzero(sieves[width][got & low])
                    got, own = got[maybe], own[maybe]
                    at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                    hit = keys[at] == got
                    for r, h in zip(own[hit].tolist(), got[hit].view(np.int64).tolist()):
                        found[r].add(h)
                if found:
                    at = pa.array(sorted(found), pa.int64())
                    sub = batch.slice(i, j - i).take(at)
                    yield pa.RecordBatch.from_arrays([sub.column("doc_id"), sub.column("text"), pa.array([sorted(found[r]) for r in sorted(found)], pa.list_(pa.int64()))], ["doc_id", "text", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, hits array<long>")


def verbatim(item: str, text: str, width: int) -> dict | None:
    """The item's words in a row in the text, as they are but for case and what stands between them."""
    sides = []
    for s in (item, text):
        raw = np.frombuffer(s.encode(), np.uint8)
        starts, ends, *_ = tokens(raw, np.array([0, len(raw)]))
        low = B.LOWER[raw].tobytes()
        sides.append(b"\0" + b"".join(low[a:b] + b"\0" for a, b in zip(starts.tolist(), ends.tolist())))
    at = sides[1].find(sides[0])
    if at < 0:
        return None
    first, size = sides[1].count(b"\0", 0, at), sides[0].count(b"\0") - 1
    n = size - width + 1
    return {"n_windows": n, "n_matched": n, "similarity": 1.0, "first_word": first, "last_word": first + size, "changed": {}}


def aligned(item: str, text: str, width: int, least: float) -> dict | None:
    """The item's windows and words in the text, if enough of them stand there with consistent slots.

    Windows are chained greedily in item order, each to the place nearest to where the last one puts it.
    """
    if width < 0:
        return verbatim(item, text, -width)
    sides = []
    for s, document in ((item, False), (text, True)):
        raw = np.frombuffer(s.encode(), np.uint8)
        starts, ends, rows, kind, hashes, opens = templates(raw, np.array([0, len(raw)]))
        got, _, pos = windows(rows, kind, hashes, opens, 1, width, document)
        sides.append((raw, starts, ends, kind, opens, got, pos))
    (raw_a, sa, ea, ka, oa, ga, pa_), (raw_b, sb, eb, kb, ob, gb, pb) = sides
    order = np.argsort(gb, kind="stable")
    lows, highs = np.searchsorted(gb[order], ga, "left"), np.searchsorted(gb[order], ga, "right")
    places: dict[int, np.ndarray] = {}
    for p, lo, hi in zip(pa_.tolist(), lows.tolist(), highs.tolist()):
        if hi > lo:
            places[p] = np.union1d(places.get(p, np.zeros(0, np.int64)), pb[order[lo:hi]])
    n_windows = len(np.unique(pa_))
    word = lambda raw, s, e, i: B.LOWER[raw[s[i] : e[i]]].tobytes()
    own = [word(raw_a, sa, ea, i) for i in range(len(sa))]

    def slot(i: int, names: bool) -> tuple[int, bytes] | None:
        return (NAME if oa[i] else int(ka[i]), own[i]) if ka[i] != LITERAL or names and oa[i] else None

    def same(i: int, j: int, value: bytes, names: bool) -> bool:
        """Whether word i of the item and word j of the text can stand for each other."""
        if key := slot(i, names):
            return kb[j] == key[0] or key[0] == NAME and bool(ob[j])
        return own[i] == value

    def judged(chain: list[tuple[int, int]], names: bool) -> dict | None:
        values, matched, sound, to = {}, 0, True, {}
        for p, q in chain:
            whole = True
            for t in range(width):
                i, value = p + t, word(raw_b, sb, eb, q + t)
                if key := slot(i, names):
                    sound &= values.setdefault(key, value) == value
                elif own[i] != value:
                    whole = False
                    continue
                to.setdefault(i, q + t)
            matched += whole
        # words beside the windows, along the diagonal of the last kept word before or after them
        taken = set(to.values())
        for turn in (1, -1):
            last = None
            for i in range(len(own))[::turn]:
                if i in to:
                    last = i
                    continue
                j = -1 if last is None or abs(i - last) > 2 * WINDOW else to[last] + i - last
                if not 0 <= j < len(sb) or j in taken:
                    continue
                value, key = word(raw_b, sb, eb, j), slot(i, names)
                if same(i, j, value, names) and (key is None or values.setdefault(key, value) == value):
                    to[i] = j
                    taken.add(j)
                    last = i
        kept, share = sorted(to), max(matched / n_windows, len(to) / len(own))
        if not sound or share + 1e-12 < least:
            kept = longest(to, names)
            if len(kept) < RUN:
                return None
        pairs = [(own[i], word(raw_b, sb, eb, to[i])) for i in kept if slot(i, names)]
        changed = {a.decode("utf-8", "replace"): b.decode("utf-8", "replace") for a, b in pairs if a != b}
        spots = [to[i] for i in kept]
        return {"n_windows": n_windows, "n_matched": matched, "similarity": share if sound else len(kept) / len(own), "first_word": min(spots), "last_word": max(spots) + 1, "changed": changed}

    def longest(to: dict[int, int], names: bool) -> list[int]:
        """The most words of the item that stand in a row in the text with consistent slots."""
        best, start, values = [], 0, {}
        for i in range(len(own)):
            if i not in to:
                start, values = i + 1, {}
                continue
            if i > start and to[i] != to[i - 1] + 1:
                start, values = i, {}
            key = slot(i, names)
            if key and values.get(key, (to[i], word(raw_b, sb, eb, to[i])))[1] != word(raw_b, sb, eb, to[i]):
                # the row goes on behind the last place of the other value
                start = values[key][0] + 1
                values = {k: v for k, v in values.items() if v[0] >= start}
            if key:
                values[key] = (i, word(raw_b, sb, eb, to[i]))
            if i + 1 - start > len(best):
                best = list(range(start, i + 1))
        return best

    best = None
    shifts: dict[int, int] = defaultdict(int)
    for p, spots in places.items():
        for q in spots.tolist():
            shifts[q - p] += 1
    seen = set()
    for shift in sorted(shifts, key=lambda d: (-shifts[d], d)):
        at, chain = shift, []
        for p in sorted(places):
            spots = places[p]
            q = int(spots[np.argmin(np.abs(spots - (p + at)))])
            if abs(q - p - shift) <= max(16, n_windows):
                chain.append((p, q))
                at = q - p
        if tuple(chain) in seen:
            continue
        seen.add(tuple(chain))
        got = judged(chain, True) or oa.any() and judged(chain, False) or None
        if got and (best is None or got["similarity"] > best["similarity"]):
            best = got
        if best and best["similarity"] >= 1:
            break
    return best


def row_of(docs: DataFrame) -> tuple[Column, Column]:
    """What tells a row of docs from others: the digest of its text and its doc_id."""
    return F.md5(docs["text"]), docs["doc_id"].cast("long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id, n_windows, n_matched, similarity,
    first_word and last_word (token positions in the document), n_changed and changed (slot values that differ)."""
    return met_items(docs, benchmark, least, block).drop("digest")


def met_items(docs: DataFrame, benchmark: DataFrame, least: float, block: int) -> DataFrame:
    """The rows of contaminated() with the digest of the document's text; a table in the shared folder."""
    with Scratch(docs.sparkSession, "templates") as scratch:
        items = scratch.table(item_windows(benchmark))
        distinct = scratch.table(items.select("width", "hash").distinct())
        blocks = max(1, -(-distinct.count() // block))
        hits = None
        for b in range(blocks):
            # two numbers for each window of a block
            got = distinct.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b).toArrow()
            width, hashes = got.column("width").to_numpy(), got.column("hash").to_numpy().view(np.uint64)
            part = document_hits(docs, {int(w): np.unique(hashes[width == w]) for w in np.unique(width)})
            hits = part if hits is None else hits.union(part)
        hits = scratch.table(hits.select(F.struct(F.md5("text").alias("digest"), F.col("doc_id").alias("id")).alias("row"), "text", "hits"))
        windows_of = hits.select("row", F.explode("hits").alias("hash")).distinct()
        texts = items.distinct().groupBy("item_id", F.xxhash64("text").alias("version"), "width", "hash", "pos").agg(F.max("n").alias("n"))
        met = windows_of.join(texts, "hash").groupBy("row", "item_id", "version", "width").agg(F.collect_set("pos").alias("at"), F.max("n").alias("n"))
        covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.abs("width") - 1)))))
        floor = F.least(F.col("n") * min(FLOOR, least), F.lit(FLOOR_WORDS))
        enough = met.where(covered >= F.when(F.col("width") > 0, floor).otherwise(F.col("n")) - 1e-9)
        named = benchmark.select(F.col("item_id").cast("long").alias("i2"), F.col("text").alias("item"), F.xxhash64("text").alias("v2")).distinct()
        pairs = enough.join(named, F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("version") == F.col("v2")))
        # a document's text once for all its items, dealt to all tasks
        pairs = pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "width", "item")).alias("items"))
        pairs = pairs.join(hits.select("row", "text").dropDuplicates(["row"]), "row").select("row", "items", "text")
        pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
        verdicts = "n_windows long, n_matched long, similarity double, first_word long, last_word long, changed map<string,string>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["n_windows", "n_matched", "similarity", "first_word", "last_word"]
            for batch in batches:
                at, ids, found = [], [], []
                for r in range(batch.num_rows):
                    text = batch.column("text")[r].as_py()
                    for item in batch.column("items")[r].as_py():
                        if got := aligned(item["item"], text, item["width"], least):
                            at.append(r)
                            ids.append(item["item_id"])
                            found.append(got)
                columns = [pa.array([f[n] for f in found], pa.float64() if n == "similarity" else pa.int64()) for n in names]
                changed = pa.array([list(f["changed"].items()) for f in found], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), *columns, changed], ["row", "item_id", *names, "changed"])

        out = pairs.mapInArrow(run, f"row struct<digest:string,id:long>, item_id long, {verdicts}")
        out = out.select(F.col("row.id").alias("doc_id"), "item_id", *(c.split()[0] for c in verdicts.split(", ")), F.size("changed").cast("long").alias("n_changed"), "row.digest")
        return cut_table(out, "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with their columns, without the contaminated rows, those of a null doc_id included."""
    bad = met_items(docs, benchmark, least, BLOCK_WINDOWS).select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id")).distinct()
    digest, own = row_of(docs)
    return docs.join(bad, (digest == F.col("__digest")) & own.eqNullSafe(F.col("__id")), "left_anti")
