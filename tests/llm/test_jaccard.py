from collections import defaultdict

from conftest import words_of

from eventmill.llm import jaccard
from eventmill.llm.common import partitions_for
from eventmill.llm.components import components


def brute(rows, width=5):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where, common = defaultdict(list), defaultdict(int)
    for d in sorted(sets):
        for s in sets[d]:
            for e in where[s]:
                common[e, d] += 1
            where[s].append(d)
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_matches_brute_force(docs, documents):
    out = jaccard.near_duplicates(docs)
    assert "_row" in out.columns
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(documents)


def test_odd_rows(odd):
    out = jaccard.near_duplicates(odd).collect()
    assert len(out) == 7
    same = [r for r in out if r.n_shingles > 1]
    assert {r.component_id for r in same} == {1} and {r.component_id for r in out if r.doc_id == 2} == {2}


def test_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", local=4).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40}


def test_tiles_lose_no_link(spark):
    """Documents of a token in tiles of two, and leaders of one: the same components."""
    base = [f"w{i}" for i in range(40)]
    rows = [(d, " ".join(base[:i] + [f"x{d}"] + base[i + 1 :])) for d, i in enumerate([0, 39, 0, 39, 1, 38, 2, 37])] + [(50 + d, f"{d} " + " ".join(base[:30])) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = jaccard.bucketed(docs, "doc_id", "text", 4, 2)
    members = jaccard.persist(jaccard.shingles_of(jaccard.with_bucket(docs, "doc_id", "text", 4, 2), 5))
    links = jaccard.similar_links(dealt, members, 4, 5, 80, 100, group=1, tile=2)
    got = {r.node: r.component for r in components(links, "_a", "_z").collect()}
    assert {d: got.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in brute(rows).items()}


def test_partitions_grow_with_the_input(spark):
    sizes = [partitions_for(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"), 100_000) for sf in ("0.01", "0.1")]
    assert 4 <= sizes[0] and 5 * sizes[0] < sizes[1] < 100 * sizes[0]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = d.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert partitions_for(joined, 100_000) < 3 * sizes[0]
    assert partitions_for(spark.createDataFrame([(1,)], "a long").repartition(9).checkpoint(), 1) < 1000
