"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves, each leaf is encoded by itself, and neighbours are joined up the tree.
A join keeps the left tokens up to a cut inside the left half and the right tokens from a cut inside the right half,
and encodes the window between the cuts again.  The cuts are places where the tokens outside provably can't change.  A match of the
pattern is a run of letters, of numbers or of marks, perhaps after one space, or of white space, or an apostrophe with letters.  So a match
ends wherever a letter, number or mark meets a character of another kind, but for an apostrophe before a letter; a match is found from where
the last one ended and from nothing before; and only white space looks ahead, and none stands before such a place.  So the tokens of
the whole are those before, of the window and after.  Only characters whose kind is the same in all versions of Unicode make a cut, as
the library has tables of its own.  The window starts at WINDOW characters on each side and grows until both cuts are found or
the half ends: text without such a place, like one run of letters, is encoded whole.  Joining is associative, so a text may be cut anywhere.

Decoding concatenates the bytes of the ids up the same kind of tree.

The vocabulary's ranks are read on the driver and sent to the tasks (under a megabyte; it doesn't grow with the data).

Cases: null is encoded like the empty text (no tokens).  Lone surrogates can't occur in Spark's strings.  Rows repeat freely; only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, WINDOW, DECODE_LEAF = 512, 24, 512
#: Characters by kind, as far as they make cuts: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul; ASCII and wide marks.
LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0391-\u03A1\u0410-\u044F\u05D0-\u05EA\u0621-\u063A\u0905-\u0939\u0E01-\u0E30\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
NUMBERS, SPACES = "0-9", r" \t\n\r\u3000"
MARKS = r"!-&(-/:-@\[-`{-~\u3001-\u3003\u3008-\u3011\uFF01-\uFF06\uFF08-\uFF0F\uFF1A-\uFF1F"
#: The last such place in the left half, and the first in the right, are the cuts.
CUT = regex.compile(
    rf"(?<=[{LETTERS}])(?=[{NUMBERS}{MARKS}'{SPACES}])|(?<=[{NUMBERS}])(?=[{LETTERS}{MARKS}'{SPACES}])"
    rf"|(?<=[{MARKS}'])(?=[{NUMBERS}{SPACES}])|(?<=[{MARKS}])(?=[{LETTERS}])|(?<=\p{{L}})(?=\s)"
)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = max(1, leaf), window
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes = {}
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            self.bytes[rank] = token

    def encode(self, text: str) -> list[int]:
        return self.tree(text, 0, len(text)) if text else []

    def tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.base.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self.tree(text, a, m), self.tree(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        lo, grow = a, self.window
        while m - grow > a:
            # the character before a cut and the one after it both lie in the left half
            found = [x.start() for x in CUT.finditer(text, m - grow, m)]
            found = [p for p in found if a < p < m]
            if found:
                lo = found[-1]
                break
            grow *= 2
        hi, grow = b, self.window
        while m + grow < b:
            found = next((x.start() for x in CUT.finditer(text, m + 1, m + grow) if m < x.start() < b), None)
            if found is not None:
                hi = found
                break
            grow *= 2
        middle = self.base.encode_ordinary(text[lo:hi])
        return self.head(left, len(text[lo:m].encode())) + middle + self.tail(right, len(text[m:hi].encode()))

    def head(self, ids: list[int], drop: int) -> list[int]:
        """`ids` without the last that make up `drop` bytes."""
        i, size = len(ids), self.size
        while drop > 0:
            i -= 1
            drop -= size[ids[i]]
        assert drop == 0
        return ids[:i]

    def tail(self, ids: list[int], drop: int) -> list[int]:
        i, size = 0, self.size
        while drop > 0:
            drop -= size[ids[i]]
            i += 1
        assert drop == 0
        return ids[i:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict[tuple, Codec] = {}


def codec(ranks, pattern: str) -> Codec:
    key = (id(ranks.value), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ids (array<int>)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.fromiter((t for x in ids for t in x), np.int32, count=int(off[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[id_col, "ids"])

    slim = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id, ids, decoded (binary)."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            lists = batch.column(1)
            texts = [c.decode(x) if x is not None else b"" for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], names=[id_col, "ids", "decoded"])

    slim = tokens.select(F.col(id_col), F.col(ids_col).alias("_i"))
    return slim.mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode` and `decode` of every whole text, in one pass."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select("doc_id", F.col("text").alias("_t"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
