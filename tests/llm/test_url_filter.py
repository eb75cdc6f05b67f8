import re

import numpy as np
import xxhash

from quillstone.llm import url_filter as U
from quillstone.llm.queries import URL_RULES


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    best = (None, "allow")
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *best


URLS = [None, "", "no scheme", "http://", "http://com/en/x", "https://A.example.COM/en/77?x", "https://example.com/en/8#y", "http://myexample.com/en/7", "ftp://x.net/de/", "http://example.net/de/85", "http://org/es", "http://a.org/es/", "http://É.com/en/", "x://y://com/en/", "http://com/en/" + "z" * 9000, "http://" + "a." * 500 + "com/en/7", "http://com?/en/", "HTTP://COM/EN/"]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3])], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = sorted(tuple(r) for r in U.judge(pages, URL_RULES).selectExpr("page_id", "host", "path", "coalesce(rule, '')", "verdict").collect())
    want = sorted((i, h, p, r or "", v) for i, u in [*enumerate(URLS), (3, URLS[3])] for h, p, r, v in [brute(u, URL_RULES)])
    assert got == want
    assert U.judge(pages.limit(0), URL_RULES).count() == 0


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda x: len(x))
    path = tmp_path / "index"
    path.write_bytes(U.build_index([("block", "aa/b"), ("allow", "cc/d"), ("block", "eeeee/f")]))
    index = U.DigestIndex(str(path))
    found = index.find([b"aa/b", b"cc/d", b"xx/y", b"eeeee/f", b"longer/one"])
    assert [f >= 0 for f in found] == [True, True, False, True, False]
    assert [U.VERDICTS[int(index.verdicts[f])] for f in found[[0, 1, 3]]] == ["block", "allow", "block"]


def test_index_is_sorted(tmp_path):
    path = tmp_path / "index"
    path.write_bytes(U.build_index(URL_RULES))
    index = U.DigestIndex(str(path))
    assert (np.diff(index.digests.astype(object)) >= 0).all()
    assert set(map(int, index.digests)) == {xxhash.xxh64_intdigest(r.encode()) for _, r in URL_RULES}
