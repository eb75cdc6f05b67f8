import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import piece_matching as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def coder():
    return P.Encoder(P.load_pieces())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def split(coder, texts):
    tokens, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    return [tokens[e - n : e].tolist() for e, n in zip(ends, counts)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abethe  \n\t.,é▁ﬁ漢🙂=--01\x00")), max_size=40), max_size=8))
def test_equals_library(coder, library, texts):
    assert split(coder, texts) == [library.encode(t) for t in texts]


def test_long_runs_and_cleared_cache(coder, library, monkeypatch):
    texts = ["", " " * 70, "=" * 300, "the " * 500, "▁▁▁▁▁▁ x", "a" * 1000]
    want = [library.encode(t) for t in texts]
    assert split(coder, texts) == want
    monkeypatch.setattr(P, "CACHE_FRAGMENTS", 3)
    r = random.Random(3)
    more = ["".join(r.choice("abc de") for _ in range(50)) for _ in range(40)]
    for t in (texts, more, texts):
        assert split(coder, t) == [library.encode(x) for x in t]


def test_decode_inverts(coder):
    texts = ["", "a b", " x", "été\n", "漢字", "\t"]
    data, sizes = coder.decode(*coder.encode(texts))
    ends = np.cumsum(sizes)
    assert [data[e - n : e].tobytes().decode() for e, n in zip(ends, sizes)] == texts


def test_query_rows(spark, library):
    rows = [(1, "the cat"), (2, None), (2, ""), (None, "x " * 5000), (4, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.encode(docs)
    got = [(r["doc_id"], r["token_ids"], r["n_tokens"], r["round_trip"], r["ids_sha256"]) for r in out.collect()]
    for (i, t), (j, ids, n, same, digest) in zip(rows, got):
        want = library.encode(t or "")
        assert (j, ids, n, same) == (i, want, len(want), True)
        assert digest == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
    assert {r["doc_id"]: r["text"] for r in P.decode(out.where("doc_id is not null")).collect()}[1] == "the cat"
    assert P.encode(docs.limit(0)).count() == 0


def test_fragments_that_share_a_hash_are_encoded_again(library, monkeypatch):
    own = P.Encoder(P.load_pieces())
    plain = P.Encoder.fragment_hashes
    monkeypatch.setattr(P.Encoder, "fragment_hashes", lambda self, points, cuts: plain(self, points, cuts) % np.uint64(7))
    texts = ["the cat sat on the mat", "", "another line of words", "the cat", "x" * 50, "é\n漢"]
    tokens, counts, same = own.encode_sure(texts)
    assert [p.tolist() for p in np.split(tokens, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts] and all(same)
    assert not np.array_equal(own.encode(texts)[0], tokens)
