"""LM scoring: Brown class-based bigrams.

P(word | last word) = P(class | last class) P(word | class), smoothed.

1. A start: the commonest `heads` words of the training texts, the text's end and "other" are put into `classes` classes by exchange: each
   word moves to the class that raises the likelihood of the class bigrams most, over the bigram counts of all training texts.
2. All training words, these among them, are then exchanged in `sweeps` rounds over the whole corpus.  Documents are dealt into buckets; a
   bucket sends its distinct words with counts of the classes before and after them to the words' owners.  These add the counts up, unclipped
   and for all classes, and move each word once to the class that its neighbours make likeliest.  In the first round, only the words of
   step 1 have classes; a word that never stands beside one (nor at a text's end) begins in a class by its hash, as exchange begins.
   In later rounds all neighbours have classes, and class bigrams are counted anew before each.
   Texts are read once: a bucket keeps its tokens as numbers of its words, and from the second round on, words are numbers of their owner.
3. Each text is reduced to sums over its tokens and a table of class transitions; the training texts' tables are added up to the transition
   probabilities, by which all texts are scored.

Counts cover all training texts.  What the driver holds is bounded by `heads` and `classes`.  The end of a text before is what a
text begins after.  A word that no training text holds has no class: its probability is shared out over the classes' unseen mass.

Cases: null is the empty text, whose only token is the end; rows without an id are for training; rows that repeat an id are texts
of their own; without training texts every word is unseen and scores come from the smoothing alone; long texts are taken whole; input columns
stay, but those named like a result are replaced.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, chunks, forget, in_order, loose, owner, pack, partitions_for, persist, scatter, trimmed, unpack, utf8, whole, word_hashes

HEADS, CLASSES, ROUNDS, SWEEPS = 768, 24, 6, 5
#: Buckets for each partition: a round sends a blob from each bucket to each owner.
PER_PARTITION = 2
#: Partitions for each owner of words in the rounds: fewer and larger blobs.
PER_OWNER = 2
#: Distinct words that a task counts before it sends the counts on.
HELD = 1 << 20
#: The end of a text, as a token.
END = np.uint64(0x5EED0FE2D0C5)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, and where each text's tokens start (n + 1)."""
    hashes, sizes = [], []
    for a, b in chunks(off):
        w, first = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        n = np.diff(first)
        out = np.full(len(w) + len(n), END, np.uint64)
        at = np.arange(len(w)) + np.repeat(np.arange(len(n)), n)
        out[at] = w
        hashes.append(out)
        sizes.append(n + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def head_words(train: DataFrame, text_col: str, heads: int, partitions: int, held: int = HELD) -> np.ndarray:
    """Hashes of the commonest words, sorted. All words are counted by their owners; each owner names its commonest."""

    def run(batches):
        word, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def send():
            order, where, cut = scatter(owner(word, partitions))
            out = [pack(word[e], n[e]) for e in (order[cut[j] : cut[j + 1]] for j in range(len(where)))]
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(out, pa.binary())], names=["_p", "_x"])

        for batch in batches:
            h, _ = tokens(*utf8(batch.column(0)))
            w, c = counted(h)
            word, back = np.unique(np.concatenate((word, w)), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate((n, c)), minlength=len(word)).astype(np.int64)
            if len(word) > held:  # bounded memory: the owner adds up what comes in parts
                yield send()
                word, n = word[:0], n[:0]
        yield send()

    def top(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("_x").to_pylist()]
        word, back = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([p[1].astype(np.int64) for p in parts])).astype(np.int64)
        own = np.lexsort((word.view(np.int64), -n))[: heads + 1]
        return pa.table({"w": word[own].view(np.int64), "n": n[own]})

    rows = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "_p int, _x binary")
    rows = rows.repartition(partitions, "_p").groupBy("_p").applyInArrow(top, "w long, n long")
    words = np.array([r["w"] for r in rows.orderBy(F.desc("n"), "w").limit(heads + 1).collect()], np.int64).view(np.uint64)
    return np.sort(words[words != END][:heads])


def index_of(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Each token's place in `words`; len(words) for the end, one more for others."""
    n = len(words)
    if not n:
        return np.where(h == END, 0, 1)
    i = np.minimum(np.searchsorted(words, h), n - 1)
    return np.where(words[i] == h, i, np.where(h == END, n, n + 1))


def bigrams(train: DataFrame, text_col: str, words: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the common words, the end and others; each text begins after an end."""
    size = len(words) + 2

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            h, first = tokens(*utf8(batch.column(0)))
            i = index_of(words, h)
            before = np.concatenate(([size - 2], i[:-1]))[: len(i)]  # the last token of the text before is an end
            total += np.bincount(before * size + i, minlength=size * size)
        rows = np.flatnonzero(total.reshape(size, size).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([pack(total[r * size : (r + 1) * size]) for r in rows.tolist()], pa.binary())], names=["r", "x"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"r": t.column("r").slice(0, 1), "x": pa.array([pack(sum(unpack(x)[0].astype(np.int64) for x in t.column("x").to_pylist()))], pa.binary())})

    out = np.zeros((size, size), np.int64)
    rows = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "r int, x binary")
    for r in rows.groupBy("r").applyInArrow(add, "r int, x binary").collect():
        out[r["r"]] = unpack(bytes(r["x"]))[0]
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(a: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the rows of bigram counts `a`. The last two rows (end, others) keep classes 0 and 1 of their own."""
    n = len(a) - 2
    a = a.astype(np.float64)
    weight = a.sum(0)
    order = np.argsort(-weight[:n], kind="stable")
    own = np.full(n + 2, 2, np.int64)
    own[order] = 2 + np.arange(n) % max(1, classes - 2)
    own[n], own[n + 1] = 0, 1
    member = np.zeros((n + 2, classes))
    member[np.arange(n + 2), own] = 1
    g = member.T @ a @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            now, self_ = own[w], a[w, w]
            member[w, now] = 0
            r, c = a[w] @ member, a[:, w] @ member
            g[now] -= r
            g[:, now] -= c
            g[now, now] -= self_
            rows, cols = g.sum(1), g.sum(0)
            # what the likelihood gains by each class: its row and column of g, their crossing, its margins
            d = np.diag(g)
            gain = (xlogx(g + r) - xlogx(g)).sum(1) + (xlogx(g + c[:, None]) - xlogx(g)).sum(0)
            gain -= xlogx(d + r) - xlogx(d) + xlogx(d + c) - xlogx(d)
            gain += xlogx(d + r + c + self_) - xlogx(d)
            gain -= xlogx(rows + r.sum() + self_ + c) - xlogx(rows) + xlogx(cols + c.sum() + self_ + r) - xlogx(cols)
            best = 2 + int(np.argmax(gain[2:])) if classes > 2 else now
            if gain[best] <= gain[now] + 1e-9:
                best = now
            moved += best != now
            own[w] = best
            member[w, best] = 1
            g[best] += r
            g[:, best] += c
            g[best, best] += self_
        if not moved:
            break
    return own


def neighbours(entry: np.ndarray, kind: np.ndarray, use: np.ndarray, size: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `size` entries, how many classes stand beside it; these (before, then classes + after), ascending; how often. Tokens without a
    class (kind >= classes) say nothing. `use` holds for no end; the token before the first is an end, as the last is."""
    at = np.flatnonzero(use)
    width = np.int32 if size * 2 * classes < 1 << 31 else np.int64  # half the memory, and faster to sort
    key, n = np.zeros(0, width), np.zeros(0, np.int64)
    for side, step in ((0, -1), (classes, 1)):  # one side at a time: a sort of all tokens is the most that is held
        k = kind[np.minimum(at + step, len(kind) - 1)]
        known = k < classes
        found, m = counted(entry[at[known]].astype(width) * width(2 * classes) + (k[known] + side).astype(width))
        key, n = np.concatenate((key, found)), np.concatenate((n, m))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    return np.bincount(key // (2 * classes), minlength=size), (key % (2 * classes)).astype(np.uint8), n


def gathered(word: np.ndarray, pairs: np.ndarray, code: np.ndarray, n: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Counts of `neighbours` of entries, added up by word: size x 2 classes."""
    at = np.repeat(word, pairs) * (2 * classes) + code
    return np.bincount(at, weights=n, minlength=size * 2 * classes).reshape(size, 2 * classes)


def likeliest(beside: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class (of those from 2) that raises the likelihood of the class bigrams most, by counts of classes beside each word."""
    g = bigrams + 0.5
    gain = np.concatenate((np.log(g / g.sum(0)), np.log(g.T / g.sum(1))))  # before: g[j, k] / n_k; after: g[k, j] / n_k
    return 2 + np.round(beside @ gain[:, 2:], 6).argmax(1)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles of earlier rounds. The scheduler holds on to the last job until another one has run, and what it held is
    found in the second or third collection only."""
    gc.collect()
    for _ in range(3):
        spark.range(1).count()
        spark._jvm.System.gc()
        time.sleep(0.2)


RESULTS = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", heads: int = HEADS, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Input columns but the text, and n_tokens, n_known, train_tokens, base_score (unigrams), score (class bigrams), both log10. train: which
    rows to learn from."""
    partitions = partitions_for(docs)
    learn = docs.filter(train).select(text_col)
    words = head_words(learn, text_col, heads, partitions)
    counts = bigrams(learn, text_col, words)
    own = exchange(counts, classes) if len(words) else np.array([0, 1])
    member = np.zeros((len(own), classes))
    member[np.arange(len(own)), own] = 1
    start = member.T @ counts @ member
    names = [c for c in docs.columns if c != text_col and c not in RESULTS]
    flagged = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    dealt = bucketed(flagged, id_col, "_text", partitions, PER_PARTITION)
    common = len(words)
    owners = max(1, partitions // PER_OWNER)

    def read(t: pa.Table):
        t = in_order(t)
        data, off = utf8(t.column("_t"))
        h, first = tokens(data, off)
        learns = t.column("_row").combine_chunks().field("_train").to_numpy(zero_copy_only=False).astype(bool)
        return t, h, first, learns

    def ballots(bucket: int, ids: list[np.ndarray], where: np.ndarray, cut: np.ndarray, beside: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, list]:
        """A blob for each owner: what `ids` says of the entries in its part of the bucket's, and the classes beside them."""
        pairs, code, n = beside
        at = np.concatenate(([0], np.cumsum(pairs)))
        parts = [(slice(a, b), slice(at[a], at[b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return {"_p": where.tolist(), "_b": [bucket] * len(parts), "_x": [pack(*(x[e] for x in ids), pairs[e], code[q], n[q]) for e, q in parts]}

    def dealt_words(h: np.ndarray):
        """Distinct words by owner, each token's place among them, the owners, and the bounds of their parts."""
        word, back = np.unique(h, return_inverse=True)
        order, where, cut = scatter(owner(word, owners))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return word[order], place[back], where, cut

    def made_of(out: dict[str, list], rows: pa.Array | None = None) -> pa.Table:
        """Blobs of a bucket, the first of which (_p = -1) holds its tokens and words as numbers, with its rows beside it."""
        t = pa.table({"_p": pa.array(out["_p"], pa.int32()), "_b": pa.array(out["_b"], pa.int32()), "_x": pa.array(out["_x"], pa.binary())})
        if rows is None:
            return t
        n = len(out["_p"])
        return t.append_column("_rows", pa.ListArray.from_arrays(pa.array([0] + [len(rows)] * n, pa.int32()), rows))

    def entries(t: pa.Table) -> pa.Table:
        """A bucket's tokens as numbers of its distinct words, and the first votes."""
        bucket = t.column("_b")[0].as_py()
        t, h, first, learns = read(t)
        word, back, where, cut = dealt_words(h)
        use = np.repeat(learns, np.diff(first))
        i = index_of(words, h)
        kind = np.where(i == common + 1, classes, own[i])
        out = ballots(bucket, [word, np.bincount(back[use], minlength=len(word))], where, cut, neighbours(back, kind, use & (h != END), len(word), classes))
        state = pack((back & 0xFFFF).astype(np.uint16), back >> 16, first, learns.astype(np.uint8), where, cut)
        return made_of({"_p": [-1, *out["_p"]], "_b": [bucket, *out["_b"]], "_x": [state, *out["_x"]]}, loose(t.column("_row")))

    def parts_of(t: pa.Table):
        rows = sorted(zip(t.column("_b").to_pylist(), t.column("_x").to_pylist(), strict=True))
        return t.column("_p")[0].as_py(), [b for b, _ in rows], [unpack(x) for _, x in rows]

    def join(parts: list, i: int) -> np.ndarray:
        return np.concatenate([p[i].astype(np.int64) for p in parts])

    def answers_of(here: int, sums: np.ndarray, buckets: list[int], parts: list, back: np.ndarray, say) -> pa.Table:
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        out = [pack(sums)] + [pack(*say(back[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({"_b": pa.array([-1, *buckets], pa.int32()), "_p": pa.array([here] * len(out), pa.int32()), "_x": pa.array(out, pa.binary())})

    def first_answer(t: pa.Table) -> pa.Table:
        """For each entry: steps of the words' numbers here, the word's count and its class (`classes` if no training text holds it)."""
        here, buckets, parts = parts_of(t)
        word, back = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        total = np.bincount(back, weights=join(parts, 1)).astype(np.int64)
        beside = gathered(back, join(parts, 2), join(parts, 3), join(parts, 4), len(word), classes)
        kind = np.where(beside.any(1), likeliest(beside, start), 2 + (word % np.uint64(max(1, classes - 2))).astype(np.int64))
        i = index_of(words, word)
        kind = np.where(i <= common, own[np.minimum(i, common)], kind)
        kind[total == 0] = classes
        return answers_of(here, np.array([total.sum(), np.count_nonzero(total)]), buckets, parts, back, lambda e: (np.diff(e, prepend=0), total[e], kind[e].astype(np.uint8)))

    def next_answer(bigrams: np.ndarray):
        def answer(t: pa.Table) -> pa.Table:
            """For each entry its word's class; the distinct training words of each class."""
            here, buckets, parts = parts_of(t)
            back = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
            beside = gathered(back, join(parts, 1), join(parts, 2), join(parts, 3), int(back.max()) + 1, classes)
            kind = np.where(beside.any(1), likeliest(beside, bigrams), classes)
            return answers_of(here, np.bincount(kind, minlength=classes + 1)[:classes], buckets, parts, back, lambda e: (kind[e].astype(np.uint8),))

        return answer

    def told(right: pa.Table) -> list[list[np.ndarray]]:
        """Answers to a bucket, in the order of its entries."""
        return [unpack(x) for _, x in sorted(zip(right.column("_p").to_pylist(), right.column("_x").to_pylist(), strict=True))]

    def votes(bucket: int, state: list[np.ndarray], kind: np.ndarray) -> dict[str, list]:
        """Ballots by the classes so far, and the bucket's class bigrams (_p = -2)."""
        low, high, first, learns, step, _, where, cut = state
        back = low.astype(np.int64) | high.astype(np.int64) << 16
        end = int(back[-1])
        kind[end] = 0
        k = kind[back]
        use = np.repeat(learns.astype(bool), np.diff(first.astype(np.int64)))
        before = np.concatenate(([0], k[:-1]))
        g = np.bincount(before[use] * classes + k[use], minlength=classes * classes)
        out = ballots(bucket, [step], where.astype(np.int64), cut.astype(np.int64), neighbours(back, k, use & (back != end), len(step), classes))
        return {"_p": [*out["_p"], -2], "_b": [*out["_b"], bucket], "_x": [*out["_x"], pack(g)]}

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """A bucket's tokens, and its words as numbers of their owners (_p = -1), and its votes."""
        if not left.num_rows:
            return made_of({"_p": [], "_b": [], "_x": []}).append_column("_rows", pa.array([], pa.list_(pa.null())))
        bucket = left.column("_b")[0].as_py()
        low, high, first, learns, where, cut = unpack(left.column("_x")[0].as_py())
        step, total, kind = (join(told(right), i) for i in range(3))
        state = [low, high, first, learns, step, total, where, cut]
        out = votes(bucket, state, kind)
        return made_of({"_p": [-1, *out["_p"]], "_b": [bucket, *out["_b"]], "_x": [pack(*state), *out["_x"]]}, loose(rows_of(left)))

    def rows_of(t: pa.Table) -> pa.Array:
        rows = whole(t.column("_rows"))
        return (rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows).flatten()

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return made_of({"_p": [], "_b": [], "_x": []})
        return made_of(votes(left.column("_b")[0].as_py(), unpack(left.column("_x")[0].as_py()), join(told(right), 0)))

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"g": t.column("g").slice(0, 1), "x": pa.array([pack(sum(unpack(x)[0].astype(np.int64) for x in t.column("x").to_pylist()))], pa.binary())})

    def partial(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                v = unpack(x)[0].astype(np.int64)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(total)], pa.binary())], names=["g", "x"])

    def summed(df: DataFrame, size: int) -> np.ndarray:
        got = df.mapInArrow(partial, "g int, x binary").groupBy("g").applyInArrow(add, "g int, x binary").collect()
        return unpack(bytes(got[0]["x"]))[0].astype(np.int64) if got else np.zeros(size, np.int64)

    spark, schema = docs.sparkSession, "_p int, _b int, _x binary"
    kind_of_row = dealt.schema["_row"].dataType.simpleString()
    with_rows = f"{schema}, _rows array<{kind_of_row}>"
    begun = persist(dealt.groupBy("_b").applyInArrow(trimmed(entries), with_rows))
    released(spark)
    answers = persist(begun.filter("_p >= 0").select("_p", "_b", "_x").repartition(partitions, "_p").groupBy("_p").applyInArrow(trimmed(first_answer), "_b int, _p int, _x binary"))
    released(spark)
    tokens_in_all, words_in_all = summed(answers.filter("_b = -1").select("_x"), 2).tolist()
    back = answers.filter("_b >= 0").repartition(partitions, "_b").groupBy("_b")
    made = persist(begun.filter("_p = -1").select("_b", "_x", "_rows").repartition(partitions, "_b").groupBy("_b").cogroup(back).applyInArrow(trimmed(settle), with_rows))
    forget(begun), forget(answers)
    released(spark)
    first_made, state = made, made.filter("_p = -1")
    for sweep in range(2, max(2, sweeps) + 1):
        g = summed(made.filter("_p = -2").select("_x"), classes * classes).reshape(classes, classes)
        answers = persist(made.filter("_p >= 0").select("_p", "_b", "_x").repartition(partitions, "_p").groupBy("_p").applyInArrow(trimmed(next_answer(g)), "_b int, _p int, _x binary"))
        if made is not first_made:
            forget(made)
        back = answers.filter("_b >= 0").repartition(partitions, "_b").groupBy("_b")
        if sweep < sweeps:
            made = persist(state.select("_b", "_x").repartition(partitions, "_b").groupBy("_b").cogroup(back).applyInArrow(trimmed(again), schema))
            forget(answers)
        released(spark)
    distinct = summed(answers.filter("_b = -1").select("_x"), classes)
    distinct[0] = min(1, tokens_in_all)  # the end
    side = classes + 1  # and the words that no training text holds

    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"n_tokens": [], "n_known": [], "_sum": [], "_known": [], "_moves": []}
        if left.num_rows:
            low, high, first, _, _, total, _, _ = unpack(left.column("_x")[0].as_py())
            back, kind = low.astype(np.int64) | high.astype(np.int64) << 16, join(told(right), 0)
            kind[back[-1]] = 0
            kind[total == 0] = classes
            c, k, first = total.astype(np.int64)[back], kind[back], first.astype(np.int64)
            logs = np.log10(c + 0.5)
            known = c > 0
            before = np.concatenate(([0], k[:-1]))
            before[first[:-1]] = 0  # class 0 is the end's
            move = before * side + k
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                out["n_tokens"].append(b - a)
                out["n_known"].append(int(np.count_nonzero(known[a:b])))
                out["_sum"].append(float(logs[a:b].sum()))
                out["_known"].append(float(logs[a:b][known[a:b]].sum()))
                where_, n = np.unique(move[a:b], return_counts=True)
                out["_moves"].append(pack(where_, n))
        return pa.table({
            "_row": loose(rows_of(left)), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "_sum": pa.array(out["_sum"], pa.float64()), "_known": pa.array(out["_known"], pa.float64()), "_moves": pa.array(out["_moves"], pa.binary()),
        })

    fields = f"_row {kind_of_row}, n_tokens long, n_known long, _sum double, _known double, _moves binary"
    texts = persist(state.select("_b", "_x", "_rows").repartition(partitions, "_b").groupBy("_b").cogroup(back).applyInArrow(trimmed(reduce), fields))
    forget(first_made), forget(answers)
    released(spark)

    def transitions(batches):
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at, n = unpack(x)
                total[at] += n.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], names=["_x"])

    moves = summed(texts.filter("_row._train").select("_moves").mapInArrow(transitions, "_x binary"), side * side).reshape(side, side)[:classes, :classes]
    prior = (moves.sum(0) + 0.5) / (moves.sum() + 0.5 * classes)
    chance = (moves + classes * prior) / (moves.sum(1, keepdims=True) + classes)
    size = moves.sum(0) + 0.5 * (distinct + 1)  # of each class, with its unseen mass
    step = np.zeros((side, side))
    step[:classes, :classes] = np.log10(chance) - np.log10(size)
    step[classes, :classes] = np.log10(prior) - np.log10(size)  # after a word without a class
    step[:classes, classes] = np.log10(chance @ (0.5 / size))
    step[classes, classes] = np.log10(prior @ (0.5 / size))
    step = step.ravel()
    unit = float(np.log10(tokens_in_all + 0.5 * (words_in_all + 1)))

    def finish(batches):
        for batch in batches:
            more = [float(step[at] @ n) for at, n in map(unpack, batch.column("_moves").to_pylist())]
            n = batch.column("n_tokens").to_numpy()
            made = {
                "n_tokens": batch.column("n_tokens"), "n_known": batch.column("n_known"), "train_tokens": pa.array(np.full(len(n), tokens_in_all)),
                "base_score": pa.array(batch.column("_sum").to_numpy() - n * unit), "score": pa.array(batch.column("_known").to_numpy() + np.array(more)),
            }
            yield pa.RecordBatch.from_arrays([loose(batch.column("_row")), *made.values()], names=["_row", *made])

    out = texts.mapInArrow(finish, "_row " + dealt.schema["_row"].dataType.simpleString() + "".join(f", {c} {k}" for c, k in RESULTS.items()))
    return out.select(*[F.col("_row")[c].alias(c) for c in names], *RESULTS)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 1, F.lit(False))


def corpus_scores(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *RESULTS)
