"""N-gram Jaccard join: multiple-global-order filtering over word shingles.

Sets of similarity s or more share a token within the first n - ceil(s n) + 1 tokens of each, under any one order of all tokens.
So a pair must share a prefix token under each of several different orders.

1. Documents with the same set of shingles are one class (by 128 bits of the sorted set); the smallest id stands for it.
2. Order A is by hash.  Prefixes longer by l tokens share at least l, so with l about a sixteenth of the set, prefixes go to the
   tokens' owners, and a document of which fewer than l prefix tokens occur in another class is out.  Most are, with
   those that share no more than a passage with others.
3. Of those that stay, all tokens go to their owners, which answer in how many classes each occurs.  A document in which fewer than s n
   tokens occur twice is out.
4. Orders B1 .. B3 put rare tokens first (by powers of two of that number) and break ties by different hashes.  Under B1, the
   documents of a prefix token are compared with its leader, the one whose tokens are commonest on the whole (of many
   copies with changes of their own, the one they are copies of): first all with
   the leader, then, once those links have made components, all pairs of a token that lie in different components.  So
   a large group of near copies costs its size, not its square, and no link between components is lost.
5. What may be common from a shared token's places on must be enough; a candidate pair must also share prefix tokens under B2
   and B3; then the sets are intersected.  The documents of one leader are dealt to several tasks if they are many.

Hashes are of 64 bits.  Links are exact up to their collisions.

Cases: null, empty or white-space texts have an empty set, n_shingles 0, and link with nothing; with fewer words than the shingle's the
whole sequence is the one shingle; rows that repeat an id are documents of their own with one node between
them; rows without an id come last, equal texts as one node, and have component_id null where they are linked with no row that has one.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, MIX1, bucketed, chunks, dealt_anew, forget, in_order, loose, mix, owner, pack, partitions_for, persist, scatter, trimmed, unpack, utf8, with_bucket, word_hashes
from .components import components

WIDTH, NUM, DEN = 5, 80, 100
#: Buckets for each partition: tokens travel twice, so fewer and larger blobs than elsewhere.
BUCKETS = 2
#: Candidates of one leader for a task.
GROUP = 512
#: Documents of one token on either side of a tile.
TILE = 1024
SEEDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8], np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    out = []
    for a, b in chunks(off):
        w, first = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        with np.errstate(over="ignore"):
            h = np.zeros(max(0, len(w) - width + 1), np.uint64)
            for i in range(width):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
            h = mix(h)
            for i in range(b - a):
                s, e = int(first[i]), int(first[i + 1])
                if e - s >= width:
                    out.append(np.unique(h[s : e - width + 1]))
                elif e > s:
                    x = np.uint64(e - s) * MIX1
                    for v in w[s:e]:
                        x = mix(np.array([x * np.uint64(31) + v]))[0]
                    out.append(np.array([x], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n, num: int, den: int):
    """Tokens of a set of n of which it shares one with any set of similarity num/den: all but ceil(s n) - 1."""
    return n - (num * n + den - 1) // den + 1


def spare(n):
    """By how many tokens order A's prefix of a set of n is longer, and so shares more than one."""
    return n // 16


def least_shared(n, num: int, den: int):
    """Tokens that order A's prefix of a set of n shares at least with that of any similar set, the smallest of which has ceil(s n)."""
    return 1 + spare((num * n + den - 1) // den)


def rare_first(tokens: np.ndarray, level: np.ndarray, seed: int) -> np.ndarray:
    """Positions of tokens in the order (level, hash by seed)."""
    return np.lexsort((mix(tokens ^ SEEDS[seed]), level))


def alike(a: np.ndarray, b: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    """Whether sets of n and m tokens, of which a and b are those that may be common, have the similarity num/den."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (n + m - both)


def shingles_of(docs: DataFrame, width: int) -> DataFrame:
    """Per row of a bucketed table: _id, _n, _c (class), the table's _b, _row and _null."""

    def run(batches):
        for t in batches:
            data, off = utf8(t.column("_t"))
            sets = shingle_sets(data, off, width)
            n = [len(s) for s in sets]
            c = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([t.column("_b"), t.column("_id"), pa.array(n, pa.int64()), pa.array(c, pa.binary()), loose(t.column("_row"))], names=["_b", "_id", "_n", "_c", "_row"])

    return docs.mapInArrow(run, "_b int, _id long, _n long, _c binary, _row " + docs.schema["_row"].dataType.simpleString())


def reps_of(t: pa.Table, reps: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of the rows of a bucket whose id stands for a class."""
    t = in_order(t)
    ids = t.column("_id").to_numpy()
    own = np.isin(ids, reps.column("_id").to_numpy())
    t = t.filter(pa.array(own))
    data, off = utf8(t.column("_t"))
    return ids[own], shingle_sets(data, off, width)


def similar_links(docs: DataFrame, members: DataFrame, partitions: int, width: int, num: int, den: int, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """Links (a, b) between representatives, of which the components are those of all links. docs: bucketed; members: `shingles_of`."""
    reps = members.filter("_n > 0").groupBy("_c").agg(F.min(F.struct("_id", "_b")).alias("r")).select("r.*")
    reps = persist(reps.repartition(partitions, "_b"))

    def docs_with(t: pa.Table, right: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids and sets of a bucket's documents that are named in `right`."""
        some = right.filter(pc.is_valid(right.column("_id"))) if right.num_rows else right
        return reps_of(t, some, width) if t.num_rows and some.num_rows else (np.zeros(0, np.int64), [])

    def front(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [s[: prefix_size(len(s), num, den) + spare(len(s))] for s in sets]

    def by_owner(tokens: list[np.ndarray]):
        """A bucket's distinct tokens with how many of its documents have them, dealt out; and each document's places among them."""
        flat, back, n = np.unique(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        return flat, n, np.split(back, np.cumsum([len(x) for x in tokens])[:-1]) if tokens else [], *scatter(owner(flat, partitions))

    def sent(part):
        def entries(t: pa.Table, right: pa.Table) -> pa.Table:
            flat, n, _, order, where, cut = by_owner(part(docs_with(t, right)[1]))
            out = [pack(flat[e], n[e]) for e in (order[cut[i] : cut[i + 1]] for i in range(len(where)))]
            return pa.table({"_p": pa.array(where, pa.int32()), "_from": pa.array([t.column("_b")[0].as_py() if out else 0] * len(out), pa.int32()), "_x": pa.array(out, pa.binary())})

        return entries

    def levels(t: pa.Table) -> pa.Table:
        """Of each entry: 0 if its token is in one document only, else the power of two of their number."""
        here = t.column("_p")[0].as_py()
        rows = sorted(zip(t.column("_from").to_pylist(), t.column("_x").to_pylist(), strict=True))
        parts = [unpack(x) for _, x in rows]
        flat, back = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[1].astype(np.int64) for p in parts]), minlength=len(flat))[back]
        level = np.where(n > 1, np.ceil(np.log2(np.maximum(n, 1))), 0).astype(np.uint8)
        split = np.split(level, np.cumsum([len(p[0]) for p in parts])[:-1])
        told = [(b, pack(x)) for (b, _), x in zip(rows, split, strict=True) if x.any()]  # no answer: all in one document
        out = [x for _, x in told]
        return pa.table({"_b": pa.array([b for b, _ in told], pa.int32()), "_p": pa.array([here] * len(out), pa.int32()), "_x": pa.array(out, pa.binary())})

    def answered(tokens: list[np.ndarray], right: pa.Table) -> list[np.ndarray]:
        """The levels of each document's tokens."""
        flat, _, places, order, where, cut = by_owner(tokens)
        level = np.zeros(len(flat), np.uint8)
        got = {p: x for p, x in zip(right.column("_p").to_pylist(), right.column("_x").to_pylist(), strict=True) if x is not None}
        for i, p in enumerate(where.tolist()):
            if p in got:
                level[order[cut[i] : cut[i + 1]]] = unpack(got[p])[0]
        return [level[x] for x in places]

    def stay(t: pa.Table, right: pa.Table) -> pa.Table:
        """Ids of the representatives that share enough prefix tokens."""
        ids, sets = docs_with(t, right)
        own = [i for i, s, lv in zip(ids.tolist(), sets, answered(front(sets), right), strict=True) if np.count_nonzero(lv) >= least_shared(len(s), num, den)]
        return pa.table({"_id": pa.array(sorted(set(own)), pa.int64()), "_b": pa.array([t.column("_b")[0].as_py() if own else 0] * len(set(own)), pa.int32())})

    def indexed(t: pa.Table, right: pa.Table) -> pa.Table:
        """Of documents with enough common tokens: id, n, prefix tokens under B1, and the common tokens with their levels."""
        ids, sets = docs_with(t, right)
        out = {"_id": [], "_n": [], "_rank": [], "_pre": [], "_common": []}
        for doc, s, lv in zip(ids.tolist(), sets, answered(sets, right), strict=True):
            n, k = len(s), int(np.count_nonzero(lv))
            if den * k < num * n:
                continue
            # the prefix holds the n - k tokens that occur once, which index nothing
            first = rare_first(s, lv, 0)[: prefix_size(n, num, den)]
            place = np.flatnonzero(lv[first] > 0)
            own = lv > 0
            common, lv = s[own], lv[own]
            out["_id"].append(doc), out["_n"].append(n), out["_rank"].append(-float(lv.sum()) / n)
            out["_pre"].append([{"tok": a, "pos": b} for a, b in zip(s[first[place]].view(np.int64).tolist(), place.tolist(), strict=True)])
            out["_common"].append(pack(common, lv))
        return pa.table({"_id": pa.array(out["_id"], pa.int64()), "_n": pa.array(out["_n"], pa.int64()), "_rank": pa.array(out["_rank"], pa.float64()), "_pre": pa.array(out["_pre"], pa.list_(pa.struct([("tok", pa.int64()), ("pos", pa.int32())]))), "_common": pa.array(out["_common"], pa.binary())})

    text = docs.select("_b", "_id", "_t")
    null = lambda kind: F.lit(None).cast(kind)

    def asked(some: DataFrame, part) -> DataFrame:
        """Of the buckets of documents in `some` (_id, _b): those, and the owners' answers on their tokens."""
        ids = some.select("_b", "_id", null("int").alias("_p"), null("binary").alias("_x")).repartition(partitions, "_b")
        blobs = text.groupBy("_b").cogroup(ids.groupBy("_b")).applyInArrow(trimmed(sent(part)), "_p int, _from int, _x binary")
        level = blobs.repartition(partitions, "_p").groupBy("_p").applyInArrow(trimmed(levels), "_b int, _p int, _x binary")
        return level.select("_b", null("long").alias("_id"), "_p", "_x").union(some.select("_b", "_id", null("int"), null("binary"))).repartition(partitions, "_b")

    left = persist(text.groupBy("_b").cogroup(asked(reps, front).groupBy("_b")).applyInArrow(trimmed(stay), "_id long, _b int").repartition(partitions, "_b"))
    found = persist(text.groupBy("_b").cogroup(asked(left, lambda sets: sets).groupBy("_b")).applyInArrow(trimmed(indexed), "_id long, _n long, _rank double, _pre array<struct<tok: long, pos: int>>, _common binary"))

    forget(reps), forget(left)
    entries = found.select("_id", "_n", "_rank", F.inline("_pre").alias("_tok", "_pos"))
    leaders = entries.groupBy("_tok").agg(F.min(F.struct("_rank", "_id", "_n", "_pos")).alias("l"), F.count("*").alias("_m")).filter("_m > 1").select("_tok", F.col("l._id").alias("_lead"), F.col("l._n").alias("_ln"), F.col("l._pos").alias("_lpos"))

    def near(n, pos, m, place):
        """Sizes fit, and from a shared token on, so many may be common: of the first shared one, all."""
        sizes = (n * num <= m * den) & (m * num <= n * den)
        return sizes & (F.least(n - pos, m - place) * (num + den) >= (n + m) * num)

    pairs = dealt_anew(entries, "_tok").join(dealt_anew(leaders, "_tok"), "_tok").filter("_id != _lead")
    pairs = pairs.filter(near(F.col("_n"), F.col("_pos"), F.col("_ln"), F.col("_lpos"))).select(F.col("_lead").alias("_a"), F.col("_id").alias("_z")).distinct()
    # what the leaders' links leave apart: pairs of a token in different components
    comps = components(verified(pairs, found, num, den, group), "_a", "_z")
    labelled = entries.join(comps, entries["_id"] == comps["node"], "left").select("_tok", "_pos", "_id", "_n", "_rank", F.coalesce("component", "_id").alias("_comp"))
    apart = labelled.groupBy("_tok").agg(F.min("_comp").alias("lo"), F.max("_comp").alias("hi"), F.min(F.struct("_rank", "_id")).alias("_lead"), F.ceil(F.count("*") / tile).cast("int").alias("_parts"))
    apart = apart.filter("lo != hi").select("_tok", F.col("_lead._id").alias("_lead"), "_parts")
    rest = dealt_anew(labelled, "_tok").join(dealt_anew(apart, "_tok"), "_tok").filter("_id != _lead")  # the leader has been compared with all
    # documents of a token in tiles of both sides, so that none is larger than tile x tile
    own, every = F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    x = rest.select("*", own.alias("_px"), every.alias("_py")).alias("x")
    y = rest.select("*", own.alias("_py"), every.alias("_px")).alias("y")
    fits = near(F.col("x._n"), F.col("x._pos"), F.col("y._n"), F.col("y._pos"))
    same = reduce(and_, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("_tok", "_px", "_py")])
    more = x.join(y, same & (F.col("x._id") < F.col("y._id")) & (F.col("x._comp") != F.col("y._comp")) & fits)
    more = more.select(F.col("x._id").alias("_a"), F.col("y._id").alias("_z")).distinct()
    return comps.select(F.col("node").alias("_a"), F.col("component").alias("_z")).union(verified(more, found, num, den, group))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, group: int) -> DataFrame:
    """The pairs (_a, _z) that share prefix tokens under B2 and B3 and whose sets are similar. sets: _id, _n, _common."""
    pairs = pairs.select("_a", "_z", F.pmod(F.xxhash64("_z"), F.lit(1 << 20)).alias("_h"))
    many = pairs.groupBy("_a").agg(F.ceil(F.count("*") / group).cast("int").alias("_parts"))
    dealt = pairs.join(many, "_a").withColumn("_part", (F.col("_h") % F.col("_parts")).cast("int"))
    others = dealt.join(sets.select(F.col("_id").alias("_z"), "_n", "_common"), "_z").select("_a", "_part", "_z", "_n", "_common")
    leads = many.join(sets.select(F.col("_id").alias("_a"), "_n", "_common"), "_a").select("_a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("_z"), "_n", "_common")

    def pre(tokens: np.ndarray, level: np.ndarray, n: int, seed: int) -> np.ndarray:
        size = prefix_size(n, num, den) - (n - len(tokens))  # the tokens that occur once come first
        return tokens[rare_first(tokens, level, seed)[: max(0, size)]]

    def check(t: pa.Table) -> pa.Table:
        z, n, x = t.column("_z").to_pylist(), t.column("_n").to_pylist(), t.column("_common").to_pylist()
        a = t.column("_a")[0].as_py()
        read = lambda i: tuple(v.astype(k) for v, k in zip(unpack(x[i]), (np.uint64, np.uint8), strict=True))
        leads = [(n[i], *read(i)) for i, v in enumerate(z) if v is None]  # several only if rows repeat its id
        filters = [[pre(own, level, m, seed) for seed in (1, 2)] for m, own, level in leads]
        hits = []
        for i, v in enumerate(z):
            if v is not None:
                other, level = read(i)
                under = [pre(other, level, n[i], seed) for seed in (1, 2)]
                for (m, own, _), kept in zip(leads, filters, strict=True):
                    if all(np.isin(p, f).any() for p, f in zip(under, kept, strict=True)) and alike(own, other, m, n[i], num, den):
                        hits.append(v)
                        break
        return pa.table({"_a": pa.array([a] * len(hits), pa.int64()), "_z": pa.array(hits, pa.int64())})

    return others.union(leads).groupBy("_a", "_part").applyInArrow(trimmed(check), "_a long, _z long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: the input's columns but the text, n_shingles, component_id (the smallest id it is linked with, over any number of links), kept (that
    is its own)."""
    partitions = partitions_for(docs)
    dealt = bucketed(docs, id_col, text_col, partitions, BUCKETS)
    members = persist(shingles_of(with_bucket(docs, id_col, text_col, partitions, BUCKETS), width))
    links = similar_links(dealt, members, partitions, width, num, den)
    comps = components(links, "_a", "_z")
    reps = members.filter("_n > 0").groupBy("_c").agg(F.min("_id").alias("_rep"))
    # a class whose representative also stands for another class (rows that repeat an id) is in one component with it
    reps = reps.join(comps, reps["_rep"] == comps["node"], "left").select("_c", F.coalesce("component", "_rep").alias("_comp"))
    out = members.join(reps, "_c", "left")
    comp = F.coalesce("_comp", "_id")
    made_up = F.col("_row")[id_col].isNull() & (comp > F.lit(LAST_ID))
    names = [c for c in docs.columns if c not in (text_col, "n_shingles", "component_id", "kept")]
    return out.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_n").alias("n_shingles"), F.when(~made_up, comp).alias("component_id"), (comp == F.col("_id")).alias("kept"))
