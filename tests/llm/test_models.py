"""Language ID, embeddings, LM scoring, the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words_of
from pyspark.sql import functions as F

from eventmill.llm import embeddings, language, scoring

LANGS = {"xx": ["the", "that", "shing", "thond"], "yy": ["que", "eau", "pré", "tion"], "zz": ["слово", "дом", "река"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang], size=int(rng.integers(3, 40)))), lang))
    rows += [(900, None, "xx"), (901, "", None), (902, "123 !!! $$$", "yy"), (903, "the that " * 20 + "que eau tion " * 20, None), (904, "слово дом " * 3000, None), (None, "the that", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(labelled):
    got = {r.doc_id: r for r in language.predict(labelled).collect()}
    truth = {r.doc_id: r.lang for r in labelled.collect() if r.doc_id is not None and r.doc_id < 900}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.95
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in truth)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans(labelled):
    model = language.fit(labelled, "text", "lang", "doc_id")
    out = {r.doc_id: r for r in language.identify(labelled.withColumn("spans", F.lit("mine")), model).collect()}
    assert [(s.first_word, s.last_word, s.lang) for s in out[903].spans] == [(0, 39, "xx"), (40, 99, "yy")]
    assert 0.4 < out[903].score < 0.8


def test_viterbi_is_the_best_labelling():
    from itertools import product

    rng = np.random.default_rng(1)
    sizes = [0, 1, 4, 5, 3]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(first[-1], 3)).astype(np.float32)
    got = language.viterbi(scores, first, 1.0)
    value = lambda a, path: sum(scores[a + i, s] for i, s in enumerate(path)) - sum(x != y for x, y in zip(path, path[1:], strict=False))
    for a, n in zip(first, sizes, strict=False):
        if n:
            best = max(value(a, p) for p in product(range(3), repeat=n))
            assert value(a, got[a : a + n]) == pytest.approx(best, abs=1e-4)


def test_scripts_are_ranges_of_code_points():
    import pyarrow as pa

    names = list(language.RANGES)
    words = ["việt", "ngữ", "हिन्दी", "ไทย", "ქართული", "ខ្មែរ", "አማርኛ", "ελληνικά", "ἀρχή", "𠀀", "漢字かな", "한국어", "123", "“—”", "e\u0301te\u0301", "𝐱"]
    want = ["Latin", "Latin", "Devanagari", "Thai", "Georgian", "Khmer", "Ethiopic", "Greek", "Greek", "Han", "Kana", "Hangul", "none", "none", "Latin"]
    w = language.Words(pa.array([" ".join(words)]))
    got = w.scripts().tolist()
    assert [names[i] for i in got[:-1]] == want and got[-1] == language.OTHER
    letters = [sum(c.isalpha() or 0x0900 <= ord(c) < 0x1800 for c in x) for x in words]  # there, vowel signs are marks
    assert w.letters().tolist() == letters


def test_languages_of_one_lead_byte(spark):
    rng = np.random.default_rng(8)
    own = {"hi": ["नमस्ते", "हिन्दी", "भाषा"], "th": ["ภาษา", "ไทย", "ครับ"], "vi": ["tiếng", "việt", "được", "ngữ"], "ka": ["ქართული", "ენა"]}
    rows = [(i, " ".join(rng.choice(own[x], size=12)), x) for i in range(80) for x in [list(own)[i % 4]]]
    rows += [(900, "हिन्दी भाषा नमस्ते ภาษา ไทย ครับ ไทย", None), (901, "अनजान शब्द", None), (902, "ქართული", None), (902, "ქართული", None), (903, "ελληνικά", None)]
    got = {}
    for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.fit(spark.createDataFrame(rows[:80], "doc_id long, text string, lang string"), "text", "lang", "doc_id")).collect():
        assert got.setdefault(r.doc_id, r) == r  # rows that repeat get equal results
    assert all(got[i].lang_pred == x for i, _, x in rows[:80])
    assert [(s.first_word, s.last_word, s.lang) for s in got[900].spans] == [(0, 2, "hi"), (3, 6, "th")]
    assert (got[901].lang_pred, got[902].lang_pred) == ("hi", "ka")  # unknown words, but of one language's script
    assert got[903].lang_pred in own  # of no learned script: no candidate is ruled out


def test_equal_scores_go_to_the_first_language():
    import pyarrow as pa

    counts, scripts = np.ones((2, 1 << language.BITS)), np.zeros((2, language.SCRIPTS))
    scripts[:, 1] = 1
    assert language.label(language.Model(["aa", "bb"], counts, scripts), pa.array(["some words", ""]))[0] == ["aa", "und"]


def test_no_training_rows(spark, empty):
    df = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predict(df).collect()] == [("und", 0.0)]
    assert language.predict(empty).count() == 0


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(120):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 12 % 3)))
    copy = rows[5][1]
    rows += [(200, copy, rows[5][2]), (201, copy, rows[5][2]), (202, copy, None), (203, None, 1), (204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [1.0, None] + [0.0] * 14, 1), (207, [2.0 * x for x in copy], rows[5][2]), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (210, [], 1), (211, [float("inf")] + [0.0] * 15, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("tile", [16_384, 7])
def test_embeddings(spark, tile):
    rows, df = vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
    good = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (v, a) in good.items():
        for j, (w, b) in good.items():
            if i < j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j), links[j].add(i)
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert sum(len(x) for x in links.values()) > 100


def test_both_sides_of_a_tile_are_dealt(spark):
    rng = np.random.default_rng(3)
    x = np.eye(8)[0] + 0.01 * rng.normal(size=(240, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row], 1, "mine") for i, row in enumerate(x)] + [(None, [1.0] * 8, 1, "x")], "vec_id long, embedding array<double>, label int, kept string")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, tile=60).collect()}
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (239, 0, i == 0) for i in range(240))
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (0, None, None)
    ids, weight, flags = np.arange(240), np.ones(240, np.int64), np.arange(240) % 2 == 0
    unit = embeddings.units(x)
    parts = [embeddings.linked(ids, weight, unit, a, b, 0, 0.93, 1)[0] for a in (flags, ~flags) for b in (flags, ~flags)]
    assert sum(int(p[:, 1].sum()) for p in parts) == 240 * 239


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_scores(docs, documents):
    got = {r.doc_id: r for r in scoring.score(docs, ~scoring.held_out(F.col("doc_id")), heads=8, classes=5).collect()}
    seen = Counter()
    tokens = {d: [*words_of(t), None] for d, t in documents}
    for d in tokens:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            seen.update(tokens[d])
    n, v = sum(seen.values()), len(seen)
    for d, own in tokens.items():
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(own), sum(w in seen for w in own), n)
        assert got[d].base_score == pytest.approx(base, rel=1e-9) and got[d].score < 0


def test_no_text_to_learn_from(spark, empty, odd):
    assert scoring.corpus_scores(empty).count() == 0
    assert scoring.score(odd, F.lit(False)).count() == 7


def test_exchange_finds_classes():
    rng = np.random.default_rng(4)
    truth = np.arange(12) % 3
    a = np.zeros((14, 14), np.int64)
    for _ in range(4000):  # class c follows class c - 1
        i = rng.integers(12)
        a[i, rng.choice(np.flatnonzero(truth == (truth[i] + 1) % 3))] += 1
    own = scoring.exchange(a, 5)[:12]
    assert len({(x, y) for x, y in zip(truth, own, strict=True)}) == 3


def test_words_far_from_common_ones_are_clustered(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["hot", "warm", "mild", "cold"], size=60)), True) for i in range(60)]
    a, b = ([f"{x}{i}" for i in range(6)] for x in "ab")
    rows += [(100 + i, " ".join(w for _ in range(10) for w in (rng.choice(a), rng.choice(b))), True) for i in range(40)]
    rows += [(200, " ".join(w for pair in zip(a, b, strict=True) for w in pair), False), (201, " ".join([a[0], *b[:5], *a[1:], b[5]]), False)]
    out = scoring.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train"), heads=4, classes=6)
    got = {r.doc_id: r for r in out.collect()}
    assert got[200].base_score == pytest.approx(got[201].base_score)
    assert got[200].score > got[201].score + 3  # same words, but a follows b and b follows a only in the first


def test_classes_do_not_depend_on_buckets(spark, docs):
    got = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r.doc_id: r.score for r in scoring.score(docs, ~scoring.held_out(F.col("doc_id")), heads=4, classes=6).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def test_votes_keep_the_evidence():
    # one word: 1000 times between class 2 and class 3, 900 times the other way about
    beside = scoring.gathered(np.array([0, 0]), np.array([2, 2]), np.array([2, 5 + 3, 3, 5 + 2]), np.array([1000, 1000, 900, 900]), 1, 5)
    assert beside.tolist() == [[0, 0, 1000, 900, 0, 0, 0, 900, 1000, 0]]
    g = np.zeros((5, 5))
    g[2, 4] = g[4, 3] = g[3, 2] = 500
    assert scoring.likeliest(beside, g).tolist() == [4]


@pytest.mark.parametrize("held", [5, 1 << 20])
def test_head_words_are_counted_in_full(spark, held):
    # "spread" is 21st in each task, but the commonest of all
    rows = [(" ".join(f"w{task}x{i}" for i in range(20) for _ in range(3)) + " spread spread",) for task in range(4)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string")
    top = scoring.head_words(df, "text", 1, 3, held)
    h, _ = scoring.tokens(np.frombuffer(b"spread", np.uint8), np.array([0, 6]))
    assert top.tolist() == [int(h[0])]


def test_pipeline(spark, documents, tmp_path):
    import corpus_pipeline as p

    rows = [(d, (t or "") + " the that of and", "xx" if d % 2 else "yy", "s", 0) for d, t in documents] + [(500, None, "xx", "s", 0), (501, "$$$ 12", "xx", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    assert {r.doc_id for r in p.language_id(spark, docs, "").collect()} >= {d for d, _ in documents} - {100, 101, 102}
    assert not {500, 501} & {r.doc_id for r in p.language_id(spark, docs, "").collect()}
    packed = p.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in packed}
    assert len(ids) == len(packed) < len(rows) and 0 in ids


def test_packing_stage_knows_every_length(spark):
    import corpus_pipeline as p

    # lengths 1 .. 16,560, each once: the best of 16 buckets hold 1,035 each
    docs = spark.range(16_560, numPartitions=16).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', cast(id AS int))").alias("text"))
    out = p.pack(spark, docs, "").groupBy("bucket", "bucket_len").agg(F.count("*").alias("n"), F.max("n_tokens").alias("most")).collect()
    assert sorted(map(tuple, out)) == [(k, 1035 * (k + 1), 1035, 1035 * (k + 1)) for k in range(16)]


@pytest.mark.parametrize("tasks", ["2", "7"])
def test_packing_stage_fills_batches_by_id_however_many_rows(spark, tasks):
    import corpus_pipeline as p

    # 30,000 rows of 20 lengths, dealt out of order; without an id, repeated, and with one id among them
    rows = [(i * 7919 % 30_011, i % 20) for i in range(30_000)]
    rows += [(None, 3), (None, 3), (None, 19), (5, 4), (5, 4), (40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, n int").select("doc_id", F.expr("repeat('a ', n)").alias("text"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        out = p.pack(spark, docs, "").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in out) == sorted((-1 if d is None else d, n + 1) for d, n in rows)
    assert len({r.bucket for r in out}) == 16
    for k in range(16):
        own = [r for r in out if r.bucket == k]
        per = 65_536 // own[0].bucket_len
        own.sort(key=lambda r: (r.batch, r.slot))
        assert [(r.batch, r.slot) for r in own] == [divmod(i, per) for i in range(len(own))]
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)


def test_language_stage_keeps_texts_in_many_languages(spark):
    import corpus_pipeline as p

    own = {"hi": "हिन्दी", "th": "ภาษา", "ka": "ქართული", "el": "ελληνικά", "ru": "слово"}
    rows = [(i, f"{own[x]} " * 9, x) for i in range(60) for x in [list(own)[i % 5]]]
    mixed = " ".join(f"{w} " * 9 for w in own.values())
    rows += [(100, mixed, None), (100, mixed, None), (None, mixed, None), (101, None, "hi"), (102, "", "hi"), (103, "12 !?", "hi"), (None, "—", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = p.language_id(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [*range(60), 100, 100]
    assert out.filter("doc_id IS NULL").count() == 1
    assert p.language_id(spark, docs.limit(0), "").count() == 0
