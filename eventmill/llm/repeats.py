"""Suffix-array dedup: remove bytes covered by a 100-byte string that starts earlier in the corpus.

No machine can sort the suffixes of 100 TB, so the windows of `least` bytes are first dealt to blocks such that equal windows
meet: a window goes by its minimiser, the K-byte string inside it with the smallest hash.  Consecutive windows with one
minimiser travel as one segment.

1. Each bucket of documents sends the hashes of its distinct segments to the owners of those, and its distinct minimisers to the
   owners of these (about 20 and 17 bytes, for 35 bytes of text; contents are equal if minimiser and two 64-bit hashes are).  So an owner gets an entry from each bucket at most, however
   common a passage is.
2. The owners tell: a segment that occurs earlier is all repeated; one whose minimiser occurs in no other segment isn't
   repeated at all; the first of each of the others is *open*.  Open segments are those around the ends of shared passages.
3. Only open segments travel as bytes.  Each block runs the threshold-bounded interval expansion over its Burrows-Wheeler
   transform (`suffixes`); all but the first of each group of windows are repeated.  For a minimiser with more than HOT open segments
   (a passage in a great many documents), windows are dealt by their own hash instead, equal ones of a bucket once, so that
   no block gathers them.
4. Repeated ranges go back to their documents' bucket, which cuts them out.

Order is by document id, then position.  Rows that repeat an id count as one text for the order, though no window crosses rows;
rows without an id come last (see `common.bucketed`).

Cases: null counts as the empty text and stays null in `text`; texts shorter than `least` lose nothing; equal rows: the
first (by id) stays; long texts are cut into runs of segments, never truncated.  Input columns stay, but
those named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX2, _RANDOM, RangeHash, bucketed, chunks, in_order, loose, mix, owner, pack, partitions_for, scatter, trimmed, unpack, utf8, virtual_starts
from .suffixes import equal_prefix_groups, ranges

LEAST, K = 100, 32
#: Bytes of text taken at a time; a longer text is cut at multiples of it, overlapping.
SLICE = 1 << 20
#: Open segments of one minimiser from which its windows are dealt singly; bytes of a block's transform.
HOT, BLOCK = 4096, 2 << 20
EARLIER, OPEN, MANY = 1, 2, 3
_ODD = np.random.default_rng(77).integers(0, 2**63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimisers(buf: np.ndarray, valid: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of valid windows with one minimiser: first window, number of windows, hash."""
    with np.errstate(over="ignore"):
        h, width = _RANDOM[1][buf], 1
        bits = k
        assert bits & (bits - 1) == 0
        i = 0
        while width < k:  # the hash of 2w bytes from those of w
            h = h[:-width] * _ODD[i] + h[width:]
            h ^= h >> np.uint64(31)
            width, i = width * 2, i + 1
    h = mix(h)
    mask = np.uint64((1 << 22) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, got = least - k + 1, 1
    while got * 2 <= span:
        v = np.minimum(v[:-got], v[got:])
        got *= 2
    if span > got:
        v = np.minimum(v[: len(v) - (span - got)], v[span - got :])
    at = np.flatnonzero(valid[: len(v)])
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    low = (v[at] & mask).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1))))
    return at[cut], np.diff(np.append(cut, len(at))), h[low[cut]]


class Segments:
    """The segments of a bucket in order: row, start, windows, key (minimiser), content hash and another, independent one."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int, k: int):
        parts = []
        for a, b in chunks(off, SLICE):
            for lo in range(int(off[a]), max(int(off[b]), int(off[a]) + 1), SLICE):
                hi = min(int(off[b]), lo + SLICE + least - 1)
                if b - a > 1:
                    hi = int(off[b])
                buf = data[lo:hi]
                if len(buf) >= least:
                    valid = np.zeros(len(buf), bool)
                    s, e = np.maximum(off[a:b] - lo, 0), np.minimum(off[a + 1 : b + 1], hi) - lo - least + 1
                    mark = np.zeros(len(buf) + 1, np.int32)
                    ok = e > s
                    np.add.at(mark, s[ok], 1)
                    np.add.at(mark, e[ok], -1)
                    valid = np.cumsum(mark[:-1]) > 0
                    start, n, key = minimisers(buf, valid, least, k)
                    content = RangeHash(buf, 2)(start, start + n + least - 1)
                    parts.append((start + lo, n, key, content, RangeHash(buf, 0)(start, start + n + least - 1)))
                if b - a > 1:
                    break
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        self.start, self.n, self.key, self.content, self.other = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(kinds))
        self.row = np.searchsorted(off, self.start, side="right") - 1
        # the first of each content, and for each segment the number of its first
        o = np.lexsort((np.arange(len(self.key)), self.content, self.key))
        new = np.concatenate(([True], (self.key[o][1:] != self.key[o][:-1]) | (self.content[o][1:] != self.content[o][:-1]))) if len(o) else np.zeros(0, bool)
        self.first = np.empty(len(o), np.int64)
        self.first[o] = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else o
        self.lead = np.flatnonzero(self.first == np.arange(len(o)))  # in order


def bucket_arrays(t: pa.Table):
    t = in_order(t)
    data, off = utf8(t.column("_t"))
    ids = t.column("_id").to_numpy()
    return t, data, off, ids, virtual_starts(ids, np.diff(off))


def joined(parts: list[list[np.ndarray]], i: int, kind=np.int64) -> np.ndarray:
    return np.concatenate([p[i].astype(kind) for p in parts]) if parts else np.zeros(0, kind)


def content_ids(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """64 bits of (minimiser, the other hash), by which contents are dealt; with the 64 bits of the content hash they are taken for equal."""
    with np.errstate(over="ignore"):
        return mix(key + other * MIX2)


def earlier(parts: list[list[np.ndarray]]) -> np.ndarray:
    """For content entries (id, content, start, first document, steps of documents): whether the content occurs before."""
    key, content, start = joined(parts, 0, np.uint64), joined(parts, 1, np.uint64), joined(parts, 2)
    doc = np.concatenate([np.cumsum(np.concatenate((p[3].astype(np.int64), p[4].astype(np.int64)))) for p in parts])
    o = np.argsort(key, kind="stable")
    s = key[o]
    group = np.cumsum(np.concatenate(([True], s[1:] != s[:-1]))) - 1
    out = np.zeros(len(key), np.uint8)
    o = o[np.bincount(group)[group] > 1]  # most occur once
    if len(o):
        o = o[np.lexsort((start[o], doc[o], content[o], key[o]))]
        out[o[1:]] = (key[o][1:] == key[o][:-1]) & (content[o][1:] == content[o][:-1])
    return out


def differing(parts: list[list[np.ndarray]], hot: int) -> np.ndarray:
    """For minimiser entries (key, content, distinct contents in the bucket): OPEN if there are several contents, MANY if over `hot`, else 0."""
    key, content, n = joined(parts, 0, np.uint64), joined(parts, 1, np.uint64), joined(parts, 2)
    o = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[o][1:] != key[o][:-1]))
    group, cut = np.cumsum(new) - 1, np.flatnonzero(new)
    total = np.add.reduceat(n[o], cut)
    several = (np.maximum.reduceat(n[o], cut) > 1) | (np.maximum.reduceat(content[o], cut) != np.minimum.reduceat(content[o], cut))
    out = np.zeros(len(key), np.uint8)
    out[o] = np.where(several, np.where(total > hot, MANY, OPEN), 0)[group]
    return out


def runs(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by row and start, with those that touch or overlap as one."""
    o = np.lexsort((start, row))
    start, end, row = start[o], end[o], row[o]
    if not len(o):
        return start, end, row
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(row * wide + end)
    cut = np.flatnonzero(np.concatenate(([True], row[1:] * wide + start[1:] > reach[:-1])))
    return start[cut], reach[np.append(cut[1:], len(o)) - 1] - row[cut] * wide, row[cut]


def repeated_windows(segs: list[list[np.ndarray]], least: int) -> tuple[np.ndarray, ...]:
    """Of open segments (bucket, row, start, doc, virtual start, key, size, bytes): where repeated windows start."""
    bucket, row, start, doc, place, key, size = (joined(segs, i, np.uint64 if i == 5 else np.int64) for i in range(7))
    data = np.concatenate([s[7] for s in segs])
    off = np.concatenate(([0], np.cumsum(size)))
    o = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate(([True], key[o][1:] != key[o][:-1]))), len(o))  # of minimisers
    total = np.concatenate(([0], np.cumsum(size[o])))[edges]
    found, i = [], 0
    while i < len(edges) - 1:  # whole minimisers, about BLOCK bytes at a time
        j = max(i + 1, int(np.searchsorted(total, total[i] + BLOCK, side="right")) - 1)
        own = o[edges[i] : edges[j]]
        if len(own) > 1:
            text = data[ranges(off[own], size[own])]
            seg, at, group = equal_prefix_groups(text, np.concatenate(([0], np.cumsum(size[own]))), least)
            seg = own[seg]
            q = np.lexsort((place[seg] + at, doc[seg], group))
            again = np.concatenate(([False], group[q][1:] == group[q][:-1])) if len(q) else np.zeros(0, bool)
            found.append((seg[q][again], at[q][again]))
        i = j
    seg = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return bucket[seg], row[seg], start[seg] + at


def repeated_ranges(docs: DataFrame, partitions: int, least: int, k: int, hot: int) -> DataFrame:
    """Per bucket of `docs` (from `bucketed`): blobs of repeated ranges (row, start, end) of the bucket's rows in order."""

    def entries(t: pa.Table) -> pa.Table:
        bucket = t.column("_b")[0].as_py()
        _, data, off, ids, place = bucket_arrays(t)
        s = Segments(data, off, least, k)
        row = s.row[s.lead]
        at = s.start[s.lead] - off[row] + place[row]
        sent: dict[int, list] = {}
        cid, content, order, where, cut = by_content(s)
        for i, p in enumerate(where.tolist()):
            e = order[cut[i] : cut[i + 1]]
            doc = ids[row[e]]
            sent[p] = [pack(cid[e], content[e], at[e], doc[:1], np.diff(doc)), None]
        key, any_content, n, order, where, cut = by_key(s)
        for i, p in enumerate(where.tolist()):
            e = order[cut[i] : cut[i + 1]]
            sent.setdefault(p, [None, None])[1] = pack(key[e], any_content[e], n[e])
        return blobs_of({"_p": list(sent), "_from": [bucket] * len(sent)}, list(sent.values()))

    def blobs_of(numbers: dict[str, list[int]], both: list) -> pa.Table:
        """Rows with a blob on contents and one on minimisers."""
        return pa.table({**{c: pa.array(v, pa.int32()) for c, v in numbers.items()}, "_x": pa.array([x for x, _ in both], pa.binary()), "_y": pa.array([y for _, y in both], pa.binary())})

    def by_content(s: Segments):
        """Leading segments' content ids and contents, dealt out."""
        content = s.content[s.lead]
        cid = content_ids(s.key[s.lead], s.other[s.lead])
        return cid, content, *scatter(owner(cid, partitions))

    def by_key(s: Segments):
        """Distinct minimisers, one content of each and how many it has, dealt out."""
        key, first, n = np.unique(s.key[s.lead], return_index=True, return_counts=True)
        return key, s.content[s.lead][first], n, *scatter(owner(key, partitions))

    def answer(t: pa.Table) -> pa.Table:
        here = t.column("_p")[0].as_py()
        found: dict[int, list] = {}
        for kind, name in enumerate(("_x", "_y")):
            own = sorted((b, x) for b, x in zip(t.column("_from").to_pylist(), t.column(name).to_pylist(), strict=True) if x is not None)
            parts = [unpack(x) for _, x in own]
            if parts:
                got = earlier(parts) if kind == 0 else differing(parts, hot)
                for (b, _), x in zip(own, np.split(got, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True):
                    if x.any():
                        found.setdefault(b, [None, None])[kind] = pack(x)
        return blobs_of({"_b": list(found), "_p": [here] * len(found)}, list(found.values()))

    def open_up(left: pa.Table, right: pa.Table) -> pa.Table:
        to, out, what = [], [], []
        if left.num_rows:
            bucket = left.column("_b")[0].as_py()
            _, data, off, ids, place = bucket_arrays(left)
            s = Segments(data, off, least, k)
            kind = np.zeros(len(s.key), np.uint8)
            got = {(k, p): v for p, *both in zip(*(right.column(c).to_pylist() for c in ("_p", "_x", "_y")), strict=True) for k, v in enumerate(both) if v is not None}
            key, _, _, order, where, cut = by_key(s)
            state = np.zeros(len(key), np.uint8)
            for i, p in enumerate(where.tolist()):
                if (1, p) in got:
                    state[order[cut[i] : cut[i + 1]]] = unpack(got[1, p])[0]
            kind[s.lead] = state[np.searchsorted(key, s.key[s.lead])]
            _, _, order, where, cut = by_content(s)
            for i, p in enumerate(where.tolist()):
                if (0, p) in got:
                    again = s.lead[order[cut[i] : cut[i + 1]]]
                    kind[again[unpack(got[0, p])[0] > 0]] = EARLIER
            kind[s.first != np.arange(len(kind))] = EARLIER
            gone = np.flatnonzero(kind == EARLIER)
            if len(gone):
                base = off[s.row[gone]]
                first, last, row = runs(s.start[gone] - base, s.start[gone] - base + s.n[gone] + least - 1, s.row[gone])
                to.append(bucket % partitions), what.append(0), out.append(pack(np.array([bucket]), row, first, last))
            todo = np.flatnonzero(kind == OPEN)
            order, where, cut = scatter(owner(s.key[todo], partitions))
            for i, p in enumerate(where.tolist()):
                e = todo[order[cut[i] : cut[i + 1]]]
                row, size = s.row[e], s.n[e] + least - 1
                at = s.start[e] - off[row]
                to.append(p), what.append(1)
                out.append(pack(np.full(len(e), bucket), row, at, ids[row], at + place[row], s.key[e], size, data[ranges(s.start[e], size)]))
            todo = np.flatnonzero(kind == MANY)
            if len(todo):
                at = ranges(s.start[todo], s.n[todo])
                row = np.repeat(s.row[todo], s.n[todo])
                h = np.concatenate([RangeHash(data[a : a + n + least - 1], 3)(np.arange(n), np.arange(n) + least) for a, n in zip(s.start[todo].tolist(), s.n[todo].tolist(), strict=True)])
                g = np.concatenate([RangeHash(data[a : a + n + least - 1], 0)(np.arange(n), np.arange(n) + least) for a, n in zip(s.start[todo].tolist(), s.n[todo].tolist(), strict=True)])
                o = np.lexsort((at, g, h))
                new = np.concatenate(([True], (h[o][1:] != h[o][:-1]) | (g[o][1:] != g[o][:-1])))
                again, o = o[~new], o[new]
                if len(again):
                    x = at[again] - off[row[again]]
                    first, last, own = runs(x, x + least, row[again])
                    to.append(bucket % partitions), what.append(0), out.append(pack(np.array([bucket]), own, first, last))
                order, where, cut = scatter(owner(h[o], partitions))
                for i, p in enumerate(where.tolist()):
                    e = o[order[cut[i] : cut[i + 1]]]
                    x = at[e] - off[row[e]]
                    to.append(p), what.append(2)
                    out.append(pack(np.full(len(e), bucket), row[e], x, ids[row[e]], x + place[row[e]], h[e], g[e]))
        return pa.table({"_p": pa.array(to, pa.int32()), "_kind": pa.array(what, pa.int32()), "_x": pa.array(out, pa.binary())})

    def expand(t: pa.Table) -> pa.Table:
        buckets, out, segs, single = [], [], [], []
        for kind, x in sorted(zip(t.column("_kind").to_pylist(), t.column("_x").to_pylist(), strict=True)):
            if kind == 0:
                b, row, first, last = unpack(x)
                buckets.append(int(b[0])), out.append(pack(row, first, last))
            else:
                (segs if kind == 1 else single).append(unpack(x))
        found = []
        if segs:
            found.append(repeated_windows(segs, least))
        if single:
            bucket, row, at, doc, place, h, g = (joined(single, i, np.uint64 if i > 4 else np.int64) for i in range(7))
            o = np.lexsort((place, doc, g, h))
            again = o[np.concatenate(([False], (h[o][1:] == h[o][:-1]) & (g[o][1:] == g[o][:-1])))]
            found.append((bucket[again], row[again], at[again]))
        if found:
            bucket, row, at = (np.concatenate([f[i] for f in found]) for i in range(3))
            order, where, cut = scatter(bucket)
            for i, b in enumerate(where.tolist()):
                e = order[cut[i] : cut[i + 1]]
                first, last, own = runs(at[e], at[e] + least, row[e])
                buckets.append(b), out.append(pack(own, first, last))
        return pa.table({"_b": pa.array(buckets, pa.int32()), "_x": pa.array(out, pa.binary())})

    blobs = docs.groupBy("_b").applyInArrow(trimmed(entries), "_p int, _from int, _x binary, _y binary")
    classes = blobs.repartition(partitions, "_p").groupBy("_p").applyInArrow(trimmed(answer), "_b int, _p int, _x binary, _y binary").repartition(partitions, "_b")
    opened = docs.groupBy("_b").cogroup(classes.groupBy("_b")).applyInArrow(trimmed(open_up), "_p int, _kind int, _x binary")
    return opened.repartition(partitions, "_p").groupBy("_p").applyInArrow(trimmed(expand), "_b int, _x binary").repartition(partitions, "_b")


RESULTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<struct<start: long, end: long>>", "kept": "binary", "kept_text": "string"}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = K, keep: tuple[str, ...] = ("spans", "kept"), hot: int = HOT) -> DataFrame:
    """Input columns but the text, and n_bytes, n_removed, n_spans, kept_sha256, and those of `keep`: spans (removed byte ranges), kept (the bytes
    that stay), kept_text (these as text, less characters that lost a part); the last two are null where the text is."""
    partitions = partitions_for(docs)
    dealt = bucketed(docs, id_col, text_col, partitions)
    spans = repeated_ranges(dealt, partitions, least, k, hot)
    names = [c for c in docs.columns if c != text_col and c not in RESULTS]
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *keep]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        t, data, off, _, _ = bucket_arrays(left)
        n = t.num_rows
        parts = [unpack(x) for x in right.column("_x").to_pylist()]
        row, first, last = (joined(parts, i) for i in range(3))
        first, last, row = runs(first, last, row)
        mark = np.zeros(len(data) + 1, np.int8)
        mark[off[row] + first] += 1
        ends = np.zeros(len(data) + 1, np.int8)
        ends[off[row] + last] += 1
        stays = np.cumsum(mark[:-1].astype(np.int32) - ends[:-1]) == 0
        kept = data[stays]
        removed = np.bincount(row, weights=last - first, minlength=n).astype(np.int64)
        spans = np.bincount(row, minlength=n)
        at = np.concatenate(([0], np.cumsum(np.diff(off) - removed)))
        texts = [kept[at[i] : at[i + 1]].tobytes() for i in range(n)]
        null = t.column("_null").to_pylist()
        made = {
            "n_bytes": pa.array(np.diff(off)),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(spans.astype(np.int64)),
            "spans": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(spans))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["start", "end"])),
            "kept": pa.array([None if z else x for x, z in zip(texts, null, strict=True)], pa.binary()) if "kept" in keep else None,
            "kept_text": pa.array([None if z else x.decode("utf-8", "ignore") for x, z in zip(texts, null, strict=True)], pa.string()) if "kept_text" in keep else None,
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        }
        return pa.table({"_row": loose(t.column("_row")), **{c: made[c] for c in results}})

    schema = ", ".join(["_row " + dealt.schema["_row"].dataType.simpleString(), *(f"{c} {RESULTS[c]}" for c in results)])
    out = dealt.groupBy("_b").cogroup(spans.groupBy("_b")).applyInArrow(trimmed(cut), schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in names], *results)


def repeat_digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), keep=())
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


