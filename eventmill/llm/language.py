"""Language identification of mixed-language text.

Words are scored against the languages that a training set holds.  The script of a word (by ranges of code points; the last
in order where it has several) leaves the languages written in it; these score by hashed byte trigrams, word edges included (smoothed log
probabilities).  Viterbi over the words with a switching penalty gives the likeliest labelling, whose runs are the spans.
A text's language is the one that most of its letters are labelled with, its score that share.

The classifier is fitted on at most `max_train` labelled rows (those with the smallest hashes of id); all else is per text.
The model is a table of 2**BITS rows by languages and is sent to the tasks: its size depends on the number of languages alone.

Cases: null text, or text without a letter, is `und` with score 0; without training rows all texts are `und`; equal scores go to the
language first in order; texts are scored whole, however long; only the id, text and label columns are read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, loose, pack, unpack, utf8

BITS, MAX_TRAIN, PENALTY, SMOOTH = 16, 20_000, 8.0, 0.5
#: Bytes of text scored at a time (whole texts).
TAKE = 4 << 20
NO_LETTER = "und"
LETTER = regex.compile(r"\p{L}")

#: Fixed by Unicode: the scripts that are told apart, as the code points of their blocks (what isn't a letter or mark in them is left out).
RANGES = {
    "none": ((0x0300, 0x036F), (0x20D0, 0x20FF), (0xFE00, 0xFE0F)),  # marks on letters of any script
    "Latin": ((0x0041, 0x007A), (0x00AA, 0x02FF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x0530, 0x058F), (0xFB13, 0xFB17)),
    "Hebrew": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Syriac": ((0x0700, 0x074F),),
    "Thaana": ((0x0780, 0x07BF),),
    "Devanagari": ((0x0900, 0x097F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x0980, 0x09FF),),
    "Gurmukhi": ((0x0A00, 0x0A7F),),
    "Gujarati": ((0x0A80, 0x0AFF),),
    "Odia": ((0x0B00, 0x0B7F),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Sinhala": ((0x0D80, 0x0DFF),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Lao": ((0x0E80, 0x0EFF),),
    "Tibetan": ((0x0F00, 0x0FFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "Cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    "Khmer": ((0x1780, 0x17FF),),
    "Mongolian": ((0x1800, 0x18AF),),
    "Han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "Bopomofo": ((0x3100, 0x312F),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
}
#: Letters of all other scripts are one; there are no letters above the last code point.
OTHER, LAST_LETTER = len(RANGES), 0x323AF
SCRIPTS = OTHER + 1


def script_table() -> np.ndarray:
    """The script of each code point: 0 for what is no letter and no mark of one."""
    out = np.array([OTHER if unicodedata.category(chr(c))[0] in "LM" else 0 for c in range(LAST_LETTER + 2)], np.uint8)
    letter = out > 0
    for i, ranges in enumerate(RANGES.values()):
        for first, last in ranges:
            out[first : last + 1] = np.where(letter[first : last + 1], i, 0)
    return out


SCRIPT = script_table()


def scripts_of(buf: np.ndarray) -> np.ndarray:
    """The script of each character of UTF-8 text at its first byte, 0 at its other bytes."""
    out = np.where(buf < 0x80, SCRIPT[buf], 0).astype(np.uint8)
    for least, most, mask, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xF7, 0x07, 3)):
        at = np.flatnonzero((buf >= least) & (buf <= most))
        point = (buf[at] & mask).astype(np.int64)
        for i in range(1, more + 1):
            point = point << 6 | (buf[at + i] & 0x3F)
        out[at] = SCRIPT[np.minimum(point, LAST_LETTER + 1)]
    return out


class Words:
    """The words of texts: where they start, which text they are of, their feature slots, scripts and letter bytes."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(texts)
        data, off = utf8(low)
        # a space before each text and at the end
        size = np.diff(off)
        buf = np.full(len(data) + len(size) + 2, 32, np.uint8)
        shift = np.repeat(np.arange(1, len(size) + 1), size)
        buf[np.arange(len(data)) + shift] = data
        word = ~SPACE[buf]
        self.start = np.flatnonzero(word & ~np.concatenate(([True], word[:-1])))
        self.end = np.flatnonzero(word & ~np.concatenate((word[1:], [True]))) + 1
        self.first = np.searchsorted(self.start, off + np.arange(len(off)))  # of each text, and the end
        buf[~word] = 32
        b = buf.astype(np.uint32)
        h = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
        self.slot = np.concatenate(([0], h >> np.uint32(32 - BITS), [0])).astype(np.int32)  # of the trigram around each byte
        self.word, self.script = word, scripts_of(buf)

    def reduce(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """Values of bytes, zero outside words, as one value for each word."""
        return how.reduceat(values, self.start, axis=0) if len(self.start) else values[:0]

    def scripts(self) -> np.ndarray:
        return self.reduce(self.script, np.maximum)

    def letters(self) -> np.ndarray:
        return self.reduce((self.script > 0).astype(np.int64))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: languages x slots; scripts: languages x scripts, in words."""
        self.languages = languages
        p = counts + SMOOTH
        self.table = np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32) if languages else np.zeros((1 << BITS, 0), np.float32)
        if languages:
            self.table -= self.table.mean(1, keepdims=True)
        share = scripts / np.maximum(1, scripts[:, 1:].sum(1, keepdims=True))
        allowed = (share >= 0.01).T  # scripts x languages
        allowed[~allowed.any(1)] = True
        allowed[0] = True
        self.barred = np.where(allowed, 0, -50).astype(np.float32)

    def scores(self, w: Words) -> np.ndarray:
        k = len(self.languages)
        out = np.empty((len(w.start), k), np.float32)
        for i in range(k):
            out[:, i] = w.reduce(np.where(w.word, self.table[:, i][w.slot], 0))
        script = w.scripts()
        return np.where(script[:, None] > 0, out + self.barred[script], 0)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The likeliest state of each word, the words of several texts being first[i] .. first[i + 1] - 1; a switch costs `penalty`."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, base = n[order], first[:-1][order]
    stay, best, state = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16), np.zeros(len(scores), np.int16)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # texts with more than t words
    v, ends = np.zeros((len(n), scores.shape[1]), np.float32), {}
    for t in range(longest):
        a = int(active[t])
        if a < len(v):
            ends[t] = (a, v[a:].argmax(1))
            v = v[:a]
        row = base[:a] + t
        top = v.argmax(1)
        jump = v[np.arange(a), top][:, None] - penalty
        keep = v >= jump
        stay[row], best[row] = keep, top
        v = np.where(keep, v, jump) + scores[row]
        v -= v.max(1, keepdims=True)
    ends[longest] = (0, v.argmax(1))
    now = np.zeros(len(n), np.int64)
    for t in range(longest, 0, -1):
        if t in ends:
            a, last = ends[t]
            now[a : a + len(last)] = last
        a = int(active[t - 1])
        row, s = base[:a] + t - 1, now[:a]
        state[row] = s
        now[:a] = np.where(stay[row, s], s, best[row])
    return state


def slices(texts: pa.Array):
    """Runs of whole texts of about TAKE bytes."""
    _, off = utf8(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + TAKE, side="right")) - 1)
        yield a, b
        a = b


def fit(docs: DataFrame, text_col: str, label_col: str, id_col: str, max_train: int = MAX_TRAIN) -> Model:
    """Fitted on the rows of `docs` with a label: all, or about `max_train` of them by the hash of their id."""
    h = F.xxhash64(F.col(id_col))
    rows = docs.filter(F.col(label_col).isNotNull())
    n = rows.count()
    if n == 0:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, SCRIPTS)))
    if n > max_train:  # by a bound on hashes: nothing is sorted or brought together
        rows = rows.filter(h < F.lit(-(2**63) + 2**64 * max_train // n))
    rows = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("string").alias("l"))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for label in pc.unique(batch.column(1)).to_pylist():
                own = batch.column(0).filter(pc.equal(batch.column(1), label))
                for a, b in slices(own):
                    w = Words(own.slice(a, b - a))
                    n = np.concatenate((np.bincount(w.slot[w.word], minlength=1 << BITS), np.bincount(w.scripts(), minlength=SCRIPTS)))
                    seen[label] = seen.get(label, 0) + n
        labels = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array([pack(seen[x]) for x in labels], pa.binary())], names=["l", "x"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpack(x)[0].astype(np.int64) for x in t.column("x").to_pylist())
        return pa.table({"l": t.column("l").slice(0, 1), "x": pa.array([pack(total)], pa.binary())})

    got = sorted((r["l"], unpack(bytes(r["x"]))[0].astype(np.float64)) for r in rows.mapInArrow(count, "l string, x binary").groupBy("l").applyInArrow(add, "l string, x binary").collect())
    counts = np.array([x for _, x in got]).reshape(len(got), -1)
    return Model([x for x, _ in got], counts[:, : 1 << BITS], counts[:, 1 << BITS :])


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))


def label(model: Model, texts: pa.Array, penalty: float = PENALTY, with_spans: bool = True) -> tuple[list[str], np.ndarray, list | None]:
    """Language, score and spans of texts without nulls."""
    langs, share, spans = [], [], []
    k = len(model.languages)
    for a, b in slices(texts):
        own = texts.slice(a, b - a)
        lettered = np.array([LETTER.search(t) is not None for t in own.to_pylist()])
        w = Words(own)
        if not k:
            langs += [NO_LETTER] * (b - a)
            share.append(np.zeros(b - a))
            spans += [[]] * (b - a)
            continue
        state = viterbi(model.scores(w), w.first, penalty)
        doc = np.repeat(np.arange(b - a), np.diff(w.first))
        weight = np.bincount(doc * k + state, weights=w.letters(), minlength=(b - a) * k).reshape(b - a, k)
        top = weight.argmax(1)
        s = weight[np.arange(b - a), top] / np.maximum(1, weight.sum(1))
        langs += [model.languages[i] if ok else NO_LETTER for i, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
        share.append(np.where(lettered, np.where(weight.sum(1) > 0, s, 1 / k), 0.0))
        if with_spans:
            cut = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])))) if len(state) else np.zeros(0, np.int64)
            last = np.append(cut[1:], len(state)) - 1
            out = [[] for _ in range(b - a)]
            for i, j in zip(cut.tolist(), last.tolist(), strict=True):
                d = int(doc[i])
                if lettered[d]:
                    out[d].append({"first_word": i - int(w.first[d]), "last_word": j - int(w.first[d]), "lang": model.languages[state[i]]})
            spans += out
    return langs, np.concatenate(share) if share else np.zeros(0), spans if with_spans else None


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """Input columns (those named like a result are replaced), lang_pred, score, and spans (runs of words, counted by white space) if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = ["lang_pred string", "score double"] + ["spans array<struct<first_word: int, last_word: int, lang: string>>"] * with_spans
    names = [c for c in docs.columns if c not in {r.split()[0] for r in results}]
    slim = docs.select(F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_row"))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).fill_null("")
            langs, score, spans = label(shared.value, texts, with_spans=with_spans)
            more = [pa.array(spans, SPANS)] if with_spans else []
            yield pa.RecordBatch.from_arrays([batch.column(0), loose(batch.column(1)), pa.array(langs, pa.string()), pa.array(score, pa.float64()), *more], names=["_text", "_row", *(r.split()[0] for r in results)])

    out = slim.mapInArrow(run, ", ".join(["_text string", "_row " + slim.schema["_row"].dataType.simpleString(), *results]))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names], *(r.split()[0] for r in results))


def held_out(id_col: Column, folds: int = 3) -> Column:
    """Remainder 1 of the id's checksum; a null id is for training."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 1, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    out = identify(docs.select("doc_id", "text"), model, with_spans=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
