import hashlib

import numpy as np
import pytest

from eventmill.llm import repeats
from eventmill.llm.suffixes import equal_prefix_groups


def brute(rows, least):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    least = int(rng.integers(1, 6))
    texts = [bytes(rng.integers(97, 99, size=int(rng.integers(0, 14))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in texts]))).astype(np.int64)
    got, want = {}, {}
    for o, p, g in zip(*equal_prefix_groups(buf, off, least), strict=True):
        got.setdefault(int(g), set()).add((int(o), int(p)))
    for i, s in enumerate(texts):
        for j in range(len(s) - least + 1):
            want.setdefault(s[j : j + least], set()).add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize(("least", "k", "hot"), [(100, 32, 4096), (24, 8, 4096), (24, 8, 2)])
def test_matches_brute_force(docs, documents, least, k, hot):
    out = repeats.remove_repeats(docs, least=least, k=k, hot=hot)
    assert "_row" in out.columns and "score" in out.columns
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == brute(documents, least)


def test_contents_that_share_many_bits_of_a_hash(spark):
    # one minimiser, and the upper 40 bits of the content hash are equal
    core = "sofhkrkrtqvwcuozqhlslgrxbnepbrkeqhyiusiqkdobddfcfipvbmiwxraredrvlckshybuvxqvsexqmsdguzvvljpe"
    rows = [(1, core + "ypjmoehr"), (2, core + "zqhwrplb")]
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    s = repeats.Segments(buf, np.array([0, 100, 200]), 100, 32)
    assert s.key[0] == s.key[1]
    assert {r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_odd_rows(odd, documents):
    out = repeats.remove_repeats(odd, least=24, k=8, keep=("kept_text", "spans")).collect()
    size = len(documents[3][1].encode())
    assert len(out) == 7 and sum(r.n_bytes for r in out) == 4 * size + 10
    copies = sorted(r.n_removed for r in out if r.n_bytes == size)
    assert copies[1:] == [size] * 3 and copies[0] < size  # one of the equal rows stays
    assert sum(r.kept_text is None for r in out) == 2
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0
