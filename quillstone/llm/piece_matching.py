"""SentencePiece encoding by suffix-array matching, and decoding.

The texts of a batch are cut where no piece of two or more characters holds the two characters at
the cut, and each distinct fragment is handled once. All fragments are concatenated and indexed by a
suffix array (sorted to the depth of the longest piece); every piece is binary-searched for its range
of occurrences; the occurrences are edges, which are sorted by position and relaxed from left to
right. The model is a BPE one, for which a segmentation is the encoding exactly if each two
neighbouring pieces, put together, encode to themselves; relaxing keeps for every position the one
edge whose piece fits the piece before it, so the result is the library's own encoding. Characters
that no piece holds fall back to bytes.

Each slice is decoded again and compared with its text. Fragments seen before are taken from a
bounded cache of the worker. Only the pieces are broadcast (a fixed vocabulary); nothing is shuffled.

Defined cases: null and empty texts have no tokens; texts are encoded whole; repeated rows each get
a row; U+2581, which stands for a space in pieces, decodes to a space, as in the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
SLICE_CHARS = 1 << 20
CACHE_FRAGMENTS, CACHE_TOKENS = 400_000, 2_500_000


def load_pieces(model: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0: ordinary, 1: byte, 2: neither."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: 1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0], .. starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes slices of texts with one vocabulary; keeps fragments it has met."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 0}
        self.rank = {p: s for p, s, kind in pieces if kind == 0}
        byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                byte_ids[int(p[3:5], 16)] = i
        self.byte_ids = byte_ids
        longer = [p for p in self.ids if len(p) > 1]
        letters = sorted({ord(c) for p in longer for c in p})
        self.n_letters = len(letters) + 1
        #: Code point -> letter number; 0: in no piece of two or more characters.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, self.n_letters)
        self.joint = np.zeros(self.n_letters**2, bool)
        for p in longer:
            at = self.letter[code_points(p)]
            self.joint[at[:-1] * self.n_letters + at[1:]] = True
        self.depth = max(map(len, longer), default=1)
        self.bits = max(1, int(self.n_letters).bit_length())
        self.per_key = 63 // self.bits
        self.n_keys = -(-self.depth // self.per_key)
        self.long_ids = np.array([self.ids[p] for p in longer], np.int64)
        self.long_sizes = np.array([len(p) for p in longer], np.int64)
        packed = np.zeros((len(longer), self.n_keys * self.per_key), np.int64)
        for i, p in enumerate(longer):
            packed[i, : len(p)] = self.letter[code_points(p)]
        self.low = self.pack(packed)
        full = packed.copy()
        full[np.arange(packed.shape[1])[None, :] >= self.long_sizes[:, None]] = (1 << self.bits) - 1
        self.high = self.pack(full)
        #: Code point -> id of its own piece, or -1: bytes.
        self.single = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.fits: dict[int, bool] = {}
        self.known_pairs = np.zeros(0, np.int64)
        self.known_fits = np.zeros(0, bool)
        raw = [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace("▁", " ").encode() for p, _, kind in pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.clear()

    def clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_start = np.zeros(0, np.int64)
        self.seen_size = np.zeros(0, np.int64)
        self.seen_tokens = np.zeros(0, np.int32)

    def pack(self, letters: np.ndarray) -> list[np.ndarray]:
        """Rows of letters as n_keys integers that sort as the rows do."""
        out = []
        for k in range(self.n_keys):
            key = np.zeros(len(letters), np.int64)
            for j in range(self.per_key):
                key = (key << self.bits) | letters[:, k * self.per_key + j]
            out.append(key)
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: of neighbours whose union is a piece, the best scored, leftmost first, are joined."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.rank.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def pair_fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the pieces of each pair (first * size + second; first = size: none) encode to themselves side by side."""
        if not len(pairs):
            return np.zeros(0, bool)
        at = np.searchsorted(self.known_pairs, pairs)
        safe = np.minimum(at, max(len(self.known_pairs) - 1, 0))
        missing = np.unique(pairs[self.known_pairs[safe] != pairs]) if len(self.known_pairs) else np.unique(pairs)
        if len(missing):
            n, new = len(self.pieces), []
            for pair in missing.tolist():
                a, b = divmod(pair, n)
                second = self.pieces[b][0]
                want = [second] if a == n else [self.pieces[a][0], second]
                new.append(self.merged(list("".join(want))) == want)
            keys = np.concatenate((self.known_pairs, missing))
            order = np.argsort(keys)
            self.known_pairs, self.known_fits = keys[order], np.concatenate((self.known_fits, np.array(new)))[order]
            safe = np.searchsorted(self.known_pairs, pairs)
        return self.known_fits[safe]

    def occurrences(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, id) of every occurrence of every longer piece in letters; 0 letters end fragments."""
        padded = np.concatenate((letters, np.zeros(self.n_keys * self.per_key, np.int32))).astype(np.int64)
        # key of per_key letters from each position, doubled up from single letters
        width, key = 1, padded.copy()
        built, filled = np.zeros(len(padded), np.int64), 0
        rest = self.per_key
        while rest:
            if rest & 1:
                shifted = np.zeros_like(key)
                shifted[: len(key) - filled or None] = key[filled:]
                built = (built << (self.bits * width)) | shifted
                filled += width
            rest >>= 1
            if rest:
                shifted = np.zeros_like(key)
                shifted[:-width] = key[width:]
                key = (key << (self.bits * width)) | shifted
                width *= 2
        n = len(letters)
        keys = [built[k * self.per_key : k * self.per_key + n] for k in range(self.n_keys)]
        live = np.flatnonzero(letters > 0)
        order = live[np.argsort(keys[0][live], kind="stable")]
        if self.n_keys > 1 and len(order):
            head = keys[0][order]
            tied = np.zeros(len(order), bool)
            tied[1:] = head[1:] == head[:-1]
            tied[:-1] |= tied[1:]
            # ties matter only where a piece is longer than the first key
            tied &= (head & ((1 << self.bits) - 1)) > 0
            where = np.flatnonzero(tied)
            sub = order[where]
            order[where] = sub[np.lexsort([k[sub] for k in keys[::-1]])]
        columns = [k[order] for k in keys]

        def bound(target: list[np.ndarray], side: str) -> np.ndarray:
            lo = np.searchsorted(columns[0], target[0], "left")
            hi = np.searchsorted(columns[0], target[0], "right")
            for k in range(1, self.n_keys):
                open_ = np.flatnonzero(hi > lo)
                for i in open_.tolist():
                    a, b = lo[i], hi[i]
                    if target[k][i] == 0 and side == "left":
                        hi[i] = a
                        continue
                    lo[i] = a + np.searchsorted(columns[k][a:b], target[k][i], "left")
                    hi[i] = a + np.searchsorted(columns[k][a:b], target[k][i], "right")
            return lo if side == "left" else hi

        first, last = bound(self.low, "left"), bound(self.high, "right")
        count = np.maximum(last - first, 0)
        start = order[gather(first, count)]
        return start, np.repeat(self.long_sizes, count), np.repeat(self.long_ids, count)

    def encode_fragments(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and their number for each fragment of points (fragment f is offsets[f] .. offsets[f + 1])."""
        sizes = np.diff(offsets)
        n = len(sizes)
        # one 0 letter between fragments
        place = np.arange(len(points)) + np.repeat(np.arange(n), sizes)
        letters = np.zeros(len(points) + n, np.int32)
        letters[place] = self.letter[points]
        base = offsets[:-1] + np.arange(n)
        start, size, piece = self.occurrences(letters)
        own = self.single[points]
        byte_id = len(self.pieces) + 1
        start = np.concatenate((place, start))
        size = np.concatenate((np.ones(len(points), np.int64), size))
        piece = np.concatenate((np.where(own >= 0, own, byte_id), piece))
        fragment = np.searchsorted(base, start, "right") - 1
        end = start + size
        reach = end - base[fragment]
        order = np.argsort(reach * (len(letters) + 1) + end, kind="stable")
        start, end, piece, reach = start[order], end[order], piece[order], reach[order]
        none, unset = len(self.pieces), -1
        last = np.full(len(letters) + 1, unset, np.int64)
        back = np.zeros(len(letters) + 1, np.int64)
        last[base] = none
        steps = np.searchsorted(reach, np.arange(1, int(sizes.max(initial=0)) + 2))
        total = len(self.pieces)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            if a == b:
                continue
            s, t = start[a:b], piece[a:b]
            before = last[s]
            good = before != unset
            plain = good & (t != byte_id) & (before != byte_id)
            check = np.flatnonzero(plain)
            good[check] = self.pair_fits(before[check] * total + t[check])
            after_byte = np.flatnonzero(good & (before == byte_id) & (t != byte_id))
            good[after_byte] = self.pair_fits(np.full(len(after_byte), none * total) + t[after_byte])
            e = end[a:b][good]
            last[e], back[e] = t[good], s[good]
        # fragments end before their 0 letter; walk all of them back at once
        at = base + sizes
        live = np.flatnonzero(sizes > 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            found.append((live, last[at[live]], back[at[live]]))
            at[live] = back[at[live]]
            live = live[at[live] > base[live]]
        if not found:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        f, t, s = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(s, kind="stable")
        f, t, s = f[order], t[order], s[order]
        lone = np.flatnonzero(t == byte_id)
        width = np.ones(len(t), np.int64)
        if len(lone):
            source = points[s[lone] - f[lone]]
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in source.tolist()]
            width[lone] = [len(x) for x in spelled]
            out = np.zeros(int(width.sum()), np.int32)
            at_ = np.cumsum(width) - width
            out[at_[t != byte_id]] = t[t != byte_id]
            flat = np.frombuffer(b"".join(spelled), np.uint8)
            out[gather(at_[lone], width[lone])] = np.array(self.byte_ids, np.int32)[flat]
        else:
            out = t.astype(np.int32)
        return out, np.bincount(f, width, n).astype(np.int64)

    def fragment_hashes(self, points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        up, down = B.powers(len(points) + 1)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        return B.mix((prefix[cuts[1:]] - prefix[cuts[:-1]]) * down[cuts[:-1]] + np.diff(cuts).astype(np.uint64))

    def encode(self, texts: list[str], hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts and the number of each text's; with hashed, fragments of equal hashes are matched once."""
        marked = [f"▁{t.replace(' ', chr(SPACE))}" if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        points = code_points("".join(marked))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        letters = self.letter[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joint[letters[:-1] * self.n_letters + letters[1:]]
        begins = np.cumsum(sizes) - sizes
        cut[begins[sizes > 0]] = True
        cuts = np.append(np.flatnonzero(cut), len(points))
        owner = np.searchsorted(np.cumsum(sizes), cuts[:-1], "right")
        if not hashed:
            tokens, count = self.encode_fragments(points, cuts)
            return tokens, np.bincount(owner, count, len(texts)).astype(np.int64)
        keys = self.fragment_hashes(points, cuts)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.seen, unique), max(len(self.seen) - 1, 0))
        new = np.flatnonzero(self.seen[at] != unique) if len(self.seen) else np.arange(len(unique))
        if len(new):
            if len(self.seen) + len(new) > CACHE_FRAGMENTS or len(self.seen_tokens) > CACHE_TOKENS:
                self.clear()
                new = np.arange(len(unique))
            a = cuts[first[new]]
            n = cuts[first[new] + 1] - a
            tokens, count = self.encode_fragments(points[gather(a, n)], np.concatenate(([0], np.cumsum(n))))
            begin = np.cumsum(count) - count + len(self.seen_tokens)
            self.seen_tokens = np.concatenate((self.seen_tokens, tokens))
            merged = np.concatenate((self.seen, unique[new]))
            order = np.argsort(merged, kind="stable")
            self.seen = merged[order]
            self.seen_start = np.concatenate((self.seen_start, begin))[order]
            self.seen_size = np.concatenate((self.seen_size, count))[order]
            at = np.searchsorted(self.seen, unique)
        place = at[inverse]
        size = self.seen_size[place]
        out = self.seen_tokens[gather(self.seen_start[place], size)]
        return out, np.bincount(owner, size, len(texts)).astype(np.int64)

    def round_trips(self, texts: list[str], tokens: np.ndarray, counts: np.ndarray) -> list[bool]:
        """Whether each text's tokens decode to it."""
        data, sizes = self.decode(tokens, counts)
        raw, at, same = data.tobytes(), 0, []
        for t, e in zip(texts, np.cumsum(sizes).tolist()):
            same.append(raw[at:e] == t.replace("▁", " ").encode())
            at = e
        return same

    def encode_sure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """As encode(), with round_trips(). Fragments that only share a hash would decode to each other: texts that fail are
        encoded again without hashes."""
        tokens, counts = self.encode(texts)
        same = self.round_trips(texts, tokens, counts)
        failed = [i for i, ok in enumerate(same) if not ok]
        if failed:
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            again, sizes = self.encode([texts[i] for i in failed], hashed=False)
            for i, part in zip(failed, np.split(again, np.cumsum(sizes)[:-1])):
                parts[i] = part
            tokens, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            same = self.round_trips(texts, tokens, counts)
        return tokens, counts, same

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and the number of each text's; the space put before a text is taken off."""
        size = self.raw_size[tokens]
        data = self.raw[gather(self.raw_start[tokens], size)]
        owner = np.repeat(np.arange(len(counts)), counts)
        sizes = np.bincount(owner, size, len(counts)).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        lead = begins[sizes > 0]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        taken = np.zeros(len(counts), np.int64)
        taken[np.searchsorted(begins, lead, "right") - 1] = 1
        return data[keep], sizes - taken


_encoders: dict[str, Encoder] = {}


def encoder(pieces: list[tuple[str, float, int]], name: str) -> Encoder:
    """The worker's encoder of this vocabulary, kept between tasks with its cache."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(pieces)
    return _encoders[name]


@lru_cache(maxsize=2)
def vocabulary(model: str) -> tuple[list[tuple[str, float, int]], str]:
    pieces = load_pieces(model)
    return pieces, hashlib.sha256(repr(pieces).encode()).hexdigest()


def encode(docs: DataFrame, model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, round_trip, ids_sha256 (of the ids as little-endian 32-bit) and, with keep_ids, token_ids."""
    pieces, name = vocabulary(model)
    state = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(state.value, name)
        for batch in batches:
            column = batch.column("text")
            _, offsets = B.flat(column)
            for i, j in B.slices(offsets, SLICE_CHARS):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                tokens, counts, same = coder.encode_sure(texts)
                stops = np.concatenate(([0], np.cumsum(counts)))
                little = tokens.astype("<i4")
                sums = [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(counts), pa.array(same, pa.bool_()), pa.array(sums)]
                names = ["doc_id", "n_tokens", "round_trip", "ids_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(tokens)))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, round_trip boolean, ids_sha256 string" + ", token_ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, token_ids); null and empty lists give empty texts."""
    pieces, name = vocabulary(model)
    state = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(state.value, name)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("token_ids").to_pylist()]
            data, sizes = coder.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
            raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
            texts = [raw[e - s : e].decode("utf-8", "replace") for s, e in zip(sizes.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
