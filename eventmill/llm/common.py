"""What the training-data operators share: tables, buckets of documents, packed blobs, checkpoints, word hashes.

Several operators look for things that whole texts have in common.  They all move data the same way:

* documents are dealt once into *buckets* by a hash of their id (`bucketed`); Spark reuses that one exchange
  wherever the same frame occurs in a plan,
* a bucket sends short fixed-width entries (hashes, counts) to the partitions that own them, packed into one
  binary blob per (bucket, partition) (`pack`, `scatter`) instead of a row per entry,
* the owner resolves them and answers with a blob of the same shape, which is cogrouped with the bucket.

So rows per task stay few, the JVM never sees an entry, and memory is bounded by a bucket.
"""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Buckets for each partition: so many evens out how hashing deals them.
BUCKETS_PER_PARTITION = 3
#: Bytes of input for each partition: a bucket of them is a third or half, and takes some 20 times its size in a task.
PARTITION_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="eventmill_")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def persist(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the checkpoint of a table from `persist` that nothing reads again, so that the shared folder holds a round or two, not all."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(f):
    """The function of a group, after which the worker gives freed memory back: workers live on, several beside an executor."""

    def give_back(out: pa.Table) -> pa.Table:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)
        return out

    # Spark counts the arguments
    return (lambda t: give_back(f(t))) if f.__code__.co_argcount == 1 else (lambda left, right: give_back(f(left, right)))


#: Ids above are made up for rows without one (`with_bucket`).
LAST_ID = 2**63 - 1 - 2**40
#: Leaves of a plan that don't know their size say about 2**63.
UNKNOWN = 1 << 60


def partitions_for(df: DataFrame, partition_bytes: int = PARTITION_BYTES) -> int:
    """Partitions by the bytes that the plan's leaves read (a join's own estimate is the product of its sides): at least what the session asks
    for, and where a leaf doesn't know its size, at least as many as the table has."""
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(n >= UNKNOWN for n in sizes):
        least = max(least, df.rdd.getNumPartitions())
    return max(least, -(-sum(n for n in sizes if n < UNKNOWN) // partition_bytes))


def bucketed(docs: DataFrame, id_col: str, text_col: str, partitions: int, per_partition: int = BUCKETS_PER_PARTITION) -> DataFrame:
    """`with_bucket`, dealt out by bucket."""
    return with_bucket(docs, id_col, text_col, partitions, per_partition).repartition(partitions, "_b")


def with_bucket(docs: DataFrame, id_col: str, text_col: str, partitions: int, per_partition: int = BUCKETS_PER_PARTITION) -> DataFrame:
    """Columns _b (bucket), _id (never null), _t (text, null as empty), _null (text was null), _row (the other columns).

    Rows without an id get one from their text at the upper end of the range, so they come after all others,
    equal ones together, and don't land in one bucket.
    """
    top = F.lit(2**63 - 1) - F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(2**40 - 1))  # above LAST_ID
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), top).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
        F.col(text_col).isNull().alias("_null"),
        F.struct(*rest).alias("_row"),
    ).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(partitions * per_partition)).cast("int"))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with keys (long) that the planner doesn't know to be dealt already, undone by `~` on the other side.

    The result of an aggregate is joined where it lies, and then adaptive execution can't split a hot key of the other side. A join on these keys
    deals both sides for the join alone, where it can; the aggregate is the small side."""
    return df.select(*[F.bitwise_not(F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns])


def whole(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def loose(a) -> pa.Array:
    """A struct column whose fields may all be null, as the schemas given to Spark say."""
    a = whole(a)
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if not pa.types.is_struct(a.type):
        return a
    fields = [loose(x) for x in a.flatten()]
    if not fields:
        return a
    return pa.StructArray.from_arrays(fields, names=[f.name for f in a.type], mask=a.is_null())


def utf8(a) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a column of strings or binaries without nulls."""
    a = whole(a)
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def in_order(t: pa.Table) -> pa.Table:
    """A bucket's rows by id, then text: the same however they arrive."""
    if t.num_rows < 2:
        return t
    ids = whole(t.column("_id")).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    if (s[1:] == s[:-1]).any():
        texts = t.column("_t").to_pylist()
        order = np.array(sorted(range(t.num_rows), key=lambda i: (ids[i], texts[i])))
    return t.take(pa.array(order))


def virtual_starts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows in order: where each begins if the rows of one id follow each other (0 for all but repeated ids)."""
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    base = np.maximum.accumulate(np.where(first, start, 0)) if len(ids) else start
    return start - base


def shrink(a: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(a)
    if a.dtype == np.uint8 or not len(a) or a.dtype.kind == "f" or a.min() < 0:
        return a
    m = int(a.max())
    return a.astype(np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32 if m < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; integers in as few bytes as they need."""
    head, body = [len(arrays)], []
    for a in map(shrink, arrays):
        head += ["iuf".index(a.dtype.kind), a.dtype.itemsize, len(a)]
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for kind, width, size in head.tolist():
        out.append(np.frombuffer(raw, np.dtype(f"{'iuf'[kind]}{width}"), size, at))
        at += width * size
    return out


def owner(key: np.ndarray, partitions: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(partitions)).astype(np.int64)


def scatter(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by destination, the destinations in use, and the bounds of their runs in that order."""
    order = np.argsort(where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where, kind="stable")
    sorted_ = where[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(where) else np.zeros(0, np.int64)
    return order, sorted_[cut], np.append(cut, len(where))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * MIX1
        x ^= x >> np.uint64(29)
        x *= MIX2
        x ^= x >> np.uint64(32)
    return x


_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, size=(4, 256), dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and inverse base to the power 0 .. n-1, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """Hashes of any byte range of a buffer from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray, row: int = 0):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_RANDOM[row][buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(x + (end - start).astype(np.uint64) * MIX2)


#: What separates words: [\x20\x09-\x0D]; and A-Z to lower case.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in a buffer (A-Z lowered), in order, and each text's first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    at = inner[(inner > 0) & (inner < len(buf))]
    begin[at] |= word[at]  # a text's first byte begins a word even if the text before ends in one
    end[at - 1] |= word[at - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return RangeHash(LOWER[buf])(s, e), np.searchsorted(s, off)


def chunks(off: np.ndarray, most: int = 1 << 20):
    """Runs of whole texts of about `most` bytes: (first, last + 1). A longer text makes its own run."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def doc_bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


