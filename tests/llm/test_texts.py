"""Encoding, lines, packing, media, URLs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from eventmill.llm import bpe, lines, media, packing, urls

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN, leaf=8, window=2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é's're 12\n\t.,!日本  xX"), max_size=120))
def test_tree_encodes_as_the_library(text):
    c = bpe.Codec.__dict__.get("_test") or bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN, leaf=8, window=2)
    bpe.Codec._test = c
    ids = c.encode(text)
    assert ids == c.base.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=90) | st.text(alphabet=st.sampled_from("aé字。，、かЖא1２0'\x1c\u3000\u0300\u00a0 \n!-_ｒ＇s"), max_size=120))
def test_any_cut_is_safe(text):
    c = bpe.Codec.__dict__.get("_test") or bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN, leaf=8, window=2)
    bpe.Codec._test = c
    whole = c.base.encode_ordinary(text)
    for cut in bpe.CUT.finditer(text):
        assert c.base.encode_ordinary(text[: cut.start()]) + c.base.encode_ordinary(text[cut.start() :]) == whole
    assert c.encode(text) == whole


@pytest.mark.parametrize("kind", ["han", "csv", "prose", "digits and marks"])
def test_long_texts_are_not_encoded_over_and_over(kind):
    rng = random.Random(kind)
    make = {
        "han": lambda: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.randint(3, 25))) + rng.choice("，。、"),
        "csv": lambda: f"{rng.random():.6f},{rng.randint(0, 999)};",
        "prose": lambda: rng.choice(["the ", "cat's ", "naïve, ", "2024\n"]),
        "digits and marks": lambda: f"{rng.randint(0, 10**9)}+({rng.randint(0, 99)})",
    }[kind]
    text = "".join(make() for _ in range(20_000))
    c = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    seen, library = 0, c.base

    class Counting:
        def encode_ordinary(self, part):
            nonlocal seen
            seen += len(part)
            return library.encode_ordinary(part)

    c.base = Counting()
    assert c.encode(text) == library.encode_ordinary(text)
    assert seen <= 1.5 * len(text)


def test_round_trip(spark, docs, documents, codec):
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    for d, t in documents:
        ids = codec.base.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()} == {d: (t or "").encode() for d, t in documents}


def test_joins_anywhere(codec):
    text = "Don't stop  now, it's 2024!\nÜber straße  naïve" * 30
    whole = codec.base.encode_ordinary(text)
    for m in random.Random(1).sample(range(1, len(text)), 60):
        assert codec.join(text, 0, m, len(text), codec.base.encode_ordinary(text[:m]), codec.base.encode_ordinary(text[m:])) == whole


def lines_brute(rows):
    strip = " \t\n\x0b\f\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    where = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and d != max(where[key(x)]))]
        out[d] = (len(every), len(every) - len(stay), "\n".join(stay))
    return out


def test_lines(docs, documents):
    out = lines.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    want = lines_brute(documents)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in out.collect()} == want
    assert want[108][1] == 2 and want[110][1] == 0


def test_odd_lines(odd):
    out = lines.dedup_lines(odd).collect()
    assert len(out) == 7 and sum(r.text is None for r in out) == 2


def test_lines_of_rows_that_repeat_an_id(spark):
    """Positions belong to a row: rows with one id and different texts lose their own lines."""
    line = "a line that is long enough"
    rows = [(1, f"x\n{line}"), (1, f"{line}\ny\n{line}"), (1, f"x\n{line}"), (2, line.upper()), (3, f" {line}\t"), (None, f"z\n\n{line}\x0b"), (None, None)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: tuple(str(v) for v in x)
    want = [(1, "x", 2, 1), (1, "x", 2, 1), (1, "y", 3, 2), (2, "", 1, 1), (3, f" {line}\t", 1, 0), (None, "z\n", 3, 1), (None, None, 1, 0)]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=key) == sorted(want, key=key)


def test_many_lines_in_one_text(spark):
    """Linear in lines, however many go: the text of a million lines loses a hundred thousand."""
    shared = "\n".join(f"shared line number {i:09}" for i in range(100_000))
    own = "\n".join(f"a line of its own {i:09}" for i in range(900_000))
    rows = [(1, own + "\n" + shared), (2, shared), (3, shared)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_lines, out[1].n_dropped, out[1].text) == (1_000_000, 100_000, own)
    assert (out[2].text, out[2].n_dropped, out[3].n_dropped) == ("", 100_000, 0)


def test_lines_are_split_once(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_packing(docs, documents, odd):
    rows = packing.pack(docs, budget=400, buckets=4).collect()
    want = {d: len(words_of(t)) + 1 for d, t in documents}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_tokens <= r.bucket_len for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert len(own) == 1 or len(own) * own[0].bucket_len <= 400
        assert sorted(r.slot for r in own) == list(range(len(own)))
    per_bucket = {}
    for (bucket, batch), own in batches.items():
        per_bucket.setdefault(bucket, {})[batch] = len(own)
    for own in per_bucket.values():  # all but the last batch are full
        assert sorted(own) == list(range(len(own))) and len({own[b] for b in range(len(own) - 1)}) <= 1
    assert packing.pack(odd).count() == 7
    assert all(r.bucket_len in want.values() for r in rows)
    cells = packing.pack(docs, budget=400, buckets=4, exact=3).collect()
    assert len(cells) == len(rows) and all(r.n_tokens <= r.bucket_len and r.bucket_len in want.values() for r in cells)


def test_best_bounds():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        x = np.sort(rng.choice(50, size=7, replace=False)) + 1
        n = rng.integers(1, 9, size=7)
        cost = lambda bounds, x=x, n=n: sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(x, n, strict=True))
        best = min(cost((*c, x[-1])) for c in combinations(x[:-1], 2))
        got = packing.best_bounds(x, n, 3)
        assert len(got) == 3 and cost(got) == best


def test_packing_knows_every_length(spark):
    # lengths 5000 .. 5039, each once: the best of 4 buckets hold 10 each, whatever comes to the driver at a time
    docs = spark.createDataFrame([(n, "a " * (n - 1)) for n in range(5000, 5040)], "doc_id long, text string")
    few = packing.pack(docs, buckets=4, exact=3).collect()
    assert {r.bucket_len for r in few} == {5009, 5019, 5029, 5039}
    assert {r.doc_id: r.bucket_len for r in few} == {n: n // 10 * 10 + 9 for n in range(5000, 5040)}
    assert sorted(few) == sorted(packing.pack(docs, buckets=4).collect())


def test_best_bounds_in_whole_numbers():
    rng = np.random.default_rng(4)
    for k in (1, 2, 5, 90):
        x, n = np.sort(rng.choice(10_000, size=80, replace=False)) + 1, rng.integers(1, 99, size=80)
        best = [0] + [10**12] * 80  # plainly, by trying each last bucket
        for _ in range(k):
            best = [0] + [min(best[i] + int(x[j - 1] * n[i:j].sum() - (x * n)[i:j].sum()) for i in range(j)) for j in range(1, 81)]
        got = packing.best_bounds(x, n, k)
        assert len(got) == min(k, 80) and sum(int(c) * (min(b for b in got if b >= v) - int(v)) for v, c in zip(x, n, strict=True)) == best[80]
        assert packing.best_bounds(x, n * 10**14, k) == got  # beyond what 64 bits hold
    # the padding is 2**55 - 1 or 2**55: as doubles they are equal
    assert packing.best_bounds(np.array([1, 2, 3]), np.array([2**55 - 1, 2**55, 1]), 2) == [2, 3]


def test_media(docs, documents):
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    for d, t in documents:
        raw = (t or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert r.corrected and r.media_type in ("audio/wav", "audio/basic", "image/png")


def test_sniffing_and_carving(spark):
    wav, png, au = media.encode_wav(b"abc"), media.encode_png(b"x" * 192), media.encode_au(b"RIFF....WAVE")
    blob = b"junk BM RIFF" + wav + b"GIF89a" + png + au
    assert [(k, at, n) for k, at, n in media.items(blob)] == [("wav", 12, len(wav)), ("png", 18 + len(wav), len(png)), ("au", 18 + len(wav) + len(png), len(au))]
    assert media.items(png[:-5]) == [] and media.items(b"") == []
    broken = bytearray(png)
    broken[40] ^= 1
    assert media.items(bytes(broken)) == []
    df = spark.createDataFrame([(1, bytearray(wav), "image/png"), (2, None, "x"), (3, bytearray(b""), "x"), (4, bytearray(blob), "text/plain")], "doc_id long, media binary, declared string")
    got = {r.doc_id: r for r in media.sniff(df).collect()}
    assert got[1].media_type == "audio/wav" and got[1].corrected and got[2].media_type is None and got[3].payload_bytes == 0
    assert len(got[4].embedded) == 3 and not got[4].corrected


CASES = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/en/123?x", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/1#a", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/fr", "x.com", "/fr", None, "allow"),
    ("http://spam-farm.net/", "spam-farm.net", "/", None, "block"),
    ("http://a.org", "a.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_rules_tried_are_those_that_may_fit():
    index = urls.Index(urls.RULES, {"org": 50, "com": 60, "example": 90, "de": 5, "fr": 6, "es": 4, "en": 9})
    assert index.key["com/de/"] == "de" and index.key["org/"] == "org"
    assert index.judge("x.net", "/en/5")[2] <= 1
    for host, path in (("a.example.org", "/es/1"), ("x.com", "/de/"), ("y.org", "/")):
        every = [r for r in urls.LISTED if __import__("re").search(r.regex, f"{host}\n{path}")]
        assert index.judge(host, path)[0] == max(every, key=lambda r: r.size).name


def test_empty(spark, empty):
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0
    assert lines.dedup_lines(empty).count() == 0 and packing.pack(empty).count() == 0 and media.media_features(empty).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
