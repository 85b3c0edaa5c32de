"""Packing: length buckets with least padding, then batches within a token budget.

The histogram of lengths over all documents is summed by Spark and goes to the driver, whole and exact however many lengths there are: m
lengths that differ have m (m + 1) / 2 tokens at least, so 10**12 tokens have under 1.5 million, of 16 bytes each.  There dynamic programming
chooses the upper bounds of `buckets` buckets with least padding in all, in whole numbers.  The cost satisfies the quadrangle inequality, so
divide and conquer finds the optimum in K m log m steps.  Of equally good bounds it takes the smaller, from the last bucket down.

A batch holds rows of one bucket, each padded to the bucket's bound, up to `budget` tokens.  A bucket's rows fill its
batches in order of id, whatever the number of rows, blocks or tasks: one range exchange sorts all rows by bucket and id,
partitions follow each other by a running sum over the small table of their sizes, and the histogram says where each
bucket begins.  So no task sees a whole bucket, however many rows it has.

Cases: null and empty texts have one token (the end).  A text longer than the budget is a batch of its own.  Rows
without an id come first; rows of one id are ordered by the text's hash; rows equal in both are interchangeable.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.orders import ranked
from .common import persist

#: Entries of the exact histogram that come to the driver at a time.
EXACT = 16_384


def word_count(text: Column) -> Column:
    """Words, and one end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def histogram(sized: DataFrame, at_once: int) -> np.ndarray:
    """All lengths, ascending, with their counts (fields length and n); about `at_once` entries travel at a time."""
    lengths = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n"))
    rows = lengths.repartition(lengths.count() // at_once + 1).toLocalIterator()
    return np.sort(np.fromiter(map(tuple, rows), [("length", np.int64), ("n", np.int64)]), order="length")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most `buckets` buckets over ascending lengths, with the least padding in all."""
    m = len(lengths)
    if m == 0:
        return []
    # padding is the room under the bounds less the tokens there are, so the least room is sought
    far = int(lengths[-1]) * int(np.sum(counts)) + 1
    whole = np.int64 if far < 1 << 62 else object  # Python's integers where 64 bits could overflow
    x, c = np.asarray(lengths).astype(whole), np.concatenate(([0], np.cumsum(counts))).astype(whole)
    # best[j]: least room for the first j lengths; lengths i .. j-1 under the bound lengths[j-1] take x[j-1] * (c[j] - c[i])
    best, back = np.full(m + 1, far, whole), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        new, arg = best.copy(), np.zeros(m + 1, np.int64)
        # ranges lo .. hi of j, whose best i are in a .. b: the middles of all ranges of a level at once
        lo, hi, a, b = (np.array([v]) for v in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j - 1) - a + 1
            start = np.cumsum(size) - size
            i, of = np.arange(size.sum()) + np.repeat(a - start, size), np.repeat(j, size)
            v = best[i] + x[of - 1] * (c[of] - c[i])
            new[j] = np.minimum.reduceat(v, start)
            least = np.flatnonzero(v == new[of])
            k = arg[j] = i[least[np.searchsorted(least, start)]]
            lo, hi, a, b = (np.concatenate(pair) for pair in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
            lo, hi, a, b = (v[left] for left in [lo <= hi] for v in (lo, hi, a, b))
        best = new
        back.append(arg)
    bounds, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(arg[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 65_536, exact: int = EXACT) -> DataFrame:
    """Per document: the id, n_tokens, bucket (from 0), bucket_len (its bound), batch (from 0 in each bucket), slot.

    `exact` entries of the histogram come to the driver at a time; no result depends on it."""
    # checkpointed: texts are read and counted once, and no later expression repeats the count
    sized = persist(docs.select(F.col(id_col), word_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")))
    lengths = histogram(sized, exact)
    bounds = best_bounds(lengths["length"], lengths["n"], buckets)
    upto = np.concatenate(([0], np.cumsum(lengths["n"])))
    edge = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(1).cast("long"))
    # rows in the buckets before each
    begin = F.array(*[F.lit(int(n)).cast("long") for n in upto[np.searchsorted(lengths["length"], [0, *bounds[:-1]], side="right")]])
    sized = sized.withColumn("bucket", F.size(F.filter(edge, lambda b: b < F.col("n_tokens"))))
    length = F.element_at(edge, F.col("bucket") + 1)
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / length))
    at = F.col("_place") - 1 - F.element_at(begin, F.col("bucket") + 1)
    return (
        ranked(sized, F.col("bucket"), F.col(id_col).asc_nulls_first(), F.col("_h"), name="_place")
        .select(F.col(id_col), "n_tokens", "bucket", length.alias("bucket_len"), F.floor(at / per).cast("long").alias("batch"), (at % per).cast("long").alias("slot"))
    )
