"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance is the logistic of a bias plus the weights of
the words it holds and of their beginnings (three to six bytes, which join inflected forms; of a shorter
word the whole); of these the FEATURES that tell the labels apart best are kept. A document's score is
their noisy-or, 1 - prod(1 - p), so one offending sentence is enough and the sentences with high chances
are the ones to show. Weights are fitted by Adam on the likelihood of document labels alone, where a
share NOISE of documents is taken to be labelled toxic without an offending sentence. Weights are not
negative: harmless words beside an offending one don't excuse it.

The fit is held to FIT_DOCUMENTS labelled rows (least hash of doc_id first) and FIT_BYTES of their
text, of rows of at most FIT_ROW_BYTES; every document is scored, whole. Inputs of a score are the
words of the text only. Rows whose crc32(doc_id as text) mod 5 is 0 are held out of the fit.

Defined cases: null and empty texts have no sentence and score 0; with no usable labels all score 0;
null labels are left out, of several labels of a document the largest counts; repeated rows each
get a row; a null doc_id is not held out and takes no part in the fit; a labelled text longer than
FIT_ROW_BYTES takes no part in it either, and those after it do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .runtime import Scratch

FIT_DOCUMENTS, FIT_BYTES, FIT_ROW_BYTES = 8000, 48 << 20, 1 << 20
PREFIXES = (3, 4, 5, 6)
FEATURES, LEAST_DOCUMENTS = 4000, 8
#: Steps of the fit, their rate, weight decay, what a toxic document counts, and the share of labels without a cause.
ROUNDS, RATE, DECAY, POSITIVE, NOISE = 200, 0.1, 2e-4, 6.0, 0.03

IS_INNER = np.ones(256, bool)
IS_INNER[list(b".!?\n\r|")] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence starts, ends and rows; hashes of words and their beginnings, and the sentences they stand in."""
    starts, ends, rows = B.spans(IS_INNER[data], offsets)
    first, last, _ = B.spans(B.IS_WORD[data], offsets)
    prefix = B.prefix_hash(B.LOWER[data])
    place = np.searchsorted(starts, first, "right") - 1
    hashes, where = [B.span_hash(prefix, first, last)], [place]
    for n in PREFIXES:
        hashes.append(B.mix(B.span_hash(prefix, first, np.minimum(first + n, last)) ^ np.uint64(n)))
        where.append(place)
    return starts, ends, rows, np.concatenate(hashes), np.concatenate(where)


def known(vocabulary: np.ndarray, hashes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted vocabulary and sentences of the features in it, each once for a sentence."""
    if not len(vocabulary) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[vocabulary & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(sieve[hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[maybe]
    pair = np.unique(sentence[maybe[hit]] * len(vocabulary) + at[hit])
    return pair % len(vocabulary), pair // len(vocabulary)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    """Sorted word hashes, their weights, and the bias of a sentence; without words every score is 0."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """z of each sentence."""
        if not len(self.vocabulary):
            return np.full(n, -np.inf)
        at, where = known(self.vocabulary, hashes, sentence)
        return self.bias + np.bincount(where, self.weights[at], n)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Noisy-or of each row, and (start, end, row, chance) of all sentences."""
        starts, ends, rows, hashes, sentence = sentences(data, offsets)
        z = self.sentence_scores(hashes, sentence, len(starts))
        total = np.bincount(rows, softplus(z), len(offsets) - 1)
        return -np.expm1(-total), (starts, ends, rows, -np.expm1(-softplus(z)))


def fit(vocabulary: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """bags: places in the vocabulary, their sentences (from 0), and the number of sentences of each document."""
    keep = [i for i, (_, _, n) in enumerate(bags) if n]
    if not keep or not len(vocabulary) or not 0 < labels[keep].sum() < len(keep):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    y = labels[keep].astype(float)
    sizes = np.array([bags[i][2] for i in keep])
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    word = np.concatenate([bags[i][0] for i in keep])
    sentence = np.concatenate([bags[i][1] + b for i, b in zip(keep, begins)])
    owner = np.repeat(np.arange(len(keep)), sizes)
    x = np.concatenate((np.zeros(len(vocabulary)), [-np.log(n / len(keep)) - 2.0]))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = x[-1] + np.bincount(sentence, x[:-1][word], n)
        p = -np.expm1(-softplus(z))
        clean = np.exp(-np.bincount(owner, softplus(z), len(keep)))
        pull = np.where(y > 0, (1 - NOISE) * clean / np.maximum(1 - (1 - NOISE) * clean, 1e-9), -1.0)
        slope = p * (pull * np.where(y > 0, POSITIVE, 1.0))[owner] / len(keep)
        grad = np.append(np.bincount(word, slope[sentence], len(vocabulary)), slope.sum())
        grad[:-1] -= DECAY * x[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        x = x + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
    used = np.abs(x[:-1]) > 0.01
    return Model(vocabulary[used], x[:-1][used], float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES, row_bytes: int = FIT_ROW_BYTES) -> Model:
    """Fits on at most most labelled documents and most_bytes of text in rows of at most row_bytes; which ones, doc_id's hash decides."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

        # the chosen ids are at most most rows of two numbers
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
        rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= row_bytes).groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x")).select("doc_id", "x.text", "x.toxic")
        ahead = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        room = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).select("doc_id", F.sum("n").over(ahead).alias("upto")).where(F.col("upto") <= most_bytes).select("doc_id")
        rows = scratch.table(rows.join(F.broadcast(room), "doc_id").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text"))
        n, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
        if not n_toxic or n_toxic == n:
            return fit(np.zeros(0, np.uint64), [], np.zeros(0, int))
        seen = rows.select("toxic", "text").mapInArrow(count_features, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        share = F.col("n") / n
        apart = F.abs(F.col("toxic") / n_toxic - (F.col("n") - F.col("toxic")) / (n - n_toxic)) / F.sqrt(share * (1 - share) + 1e-9)
        best = seen.where(F.col("n") >= min(LEAST_DOCUMENTS, max(1, n // 50))).orderBy(apart.desc(), "feature").limit(FEATURES)
        vocabulary = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))
        state = docs.sparkSession.sparkContext.broadcast(vocabulary)

        def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = B.flat(batch.column("text"))
                out: list[tuple[bytes, bytes, int]] = []
                for i, j in B.slices(offsets):
                    starts, _, rows, hashes, sentence = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    at, where = known(state.value, hashes, sentence)
                    first = np.searchsorted(rows, np.arange(j - i + 1))
                    cuts = np.searchsorted(where, first)
                    for r in range(j - i):
                        own = slice(cuts[r], cuts[r + 1])
                        out.append((at[own].astype(np.int32).tobytes(), (where[own] - first[r]).astype(np.int32).tobytes(), int(first[r + 1] - first[r])))
                columns = [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *columns], ["doc_id", "toxic", "place", "sentence", "n"])

        got = sorted(rows.mapInArrow(bag, "doc_id long, toxic int, place binary, sentence binary, n long").collect(), key=lambda r: r["doc_id"])
        number = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
        return fit(vocabulary, [(number(r["place"]), number(r["sentence"]), r["n"]) for r in got], np.array([r["toxic"] for r in got]))


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents of each feature, summed within slices."""
    for batch in batches:
        data, offsets = B.flat(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for i, j in B.slices(offsets):
            _, _, rows, hashes, sentence = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            order = np.lexsort((hashes, rows[sentence]))
            h, r = hashes[order], rows[sentence][order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            feature, place, n = np.unique(h[once], return_inverse=True, return_counts=True)
            bad = np.bincount(place, toxic[i:j][r[once]], len(feature)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(bad), pa.array(n.astype(np.int64))], ["feature", "toxic", "n"])


def scored(docs: DataFrame, model: Model, text: str = "text", spans: bool = False, inside: str | None = None) -> DataFrame:
    """docs (with inside, the text is a field of that struct) with score, predicted, n_sentences and n_offending, and with spans also offending: array of (start, end, score), in code points."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        for batch in batches:
            data, offsets = B.flat(batch.column(text) if inside is None else batch.column(inside).field(text))
            scores, count, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            where: list[list] = [[] for _ in range(batch.num_rows if spans else 0)]
            for i, j in B.slices(offsets):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                scores[i:j], (starts, ends, rows, chance) = model.score(part, offs)
                count[i:j] = np.bincount(rows, minlength=j - i)
                bad[i:j] = np.bincount(rows[chance >= 0.5], minlength=j - i)
                for s in np.flatnonzero(chance >= 0.5).tolist() if spans else ():
                    row, own = rows[s], part[offs[rows[s]] : ends[s]]
                    a = int(starts[s] - offs[row])
                    chars = np.cumsum((own & 0xC0) != 0x80)
                    where[i + row].append({"start": int(chars[a] - 1), "end": int(chars[-1]), "score": float(chance[s])})
            extra = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(count), pa.array(bad)]
            names = ["score", "predicted", "n_sentences", "n_offending"]
            if spans:
                extra.append(pa.array(where, span_type))
                names.append("offending")
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    source = docs.drop("score", "predicted", "n_sentences", "n_offending", "offending")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    added = "score double, predicted int, n_sentences long, n_offending long" + ", offending array<struct<start:long,end:long,score:double>>" * spans
    return source.mapInArrow(run, f"{fields}, {added}")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and n_offending of every row of docs."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "n_offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with their columns, without the documents that score least or more."""
    model = train(docs, labels)
    out = scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")), model, inside="__row")
    return out.where(F.col("score") < least).select("__row.*")
