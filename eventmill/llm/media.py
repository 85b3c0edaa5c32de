"""Media columns: signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a known format may begin; the validator of that
format then walks its structure (chunk lengths, checksums, markers) and says how long the item is, or that there
is none.  What is valid at offset 0 corrects the declared type; what is valid further on, and not inside an item
already found, is carved.

`store` writes bytes as lossless 8-bit samples: mono sound (WAV, AU) or an image 64 pixels wide (PNG, 3 bytes a
pixel), by the payload's checksum, declared as application/octet-stream.

Cases: null and empty text are one block of 192 spaces; null media has no type, no items and null digests; equal bytes
give equal values; very long texts are one row and are scanned once.  Columns of the input other than those named aren't
read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the formats.
MAGIC = {b"RIFF": "wav", b".snd": "au", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg", b"BM": "bmp"}
MIME = {"wav": "audio/wav", "au": "audio/basic", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp"}
BLOCK, WIDTH = 192, 64


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


# Each validator gives the length of the item that begins at `at`, or 0.
def wav_length(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, p, data = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, False
    if end > len(b):
        return 0
    while p + 8 <= end:
        data |= b[p : p + 4] == b"data"
        p += 8 + (n := int.from_bytes(b[p + 4 : p + 8], "little")) + n % 2
    return end - at if data and end <= p <= end + 1 else 0


def au_length(b: bytes, at: int) -> int:
    if len(b) < at + 24:
        return 0
    head, size, encoding, rate, channels = struct.unpack(">5I", b[at + 4 : at + 24])
    fits = 24 <= head <= 4096 and 1 <= encoding <= 27 and 0 < rate <= 1 << 20 and 1 <= channels <= 64 and at + head + size <= len(b)
    return head + size if fits else 0


def png_length(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if first and (kind != b"IHDR" or n != 13) or p + 12 + n > len(b):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def gif_length(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    images = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at if images else 0
        if kind == 0x2C and p + 11 <= len(b):
            images, p = images + 1, p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        elif kind == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def jpeg_length(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if not 0xC0 <= kind <= 0xFE or n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def bmp_length(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, reserved, pixels, head, width, height, planes, depth = struct.unpack("<IIIIiiHH", b[at + 2 : at + 30])
    fits = not reserved and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if fits and 14 + head <= pixels < size <= len(b) - at else 0


VALID = {"wav": wav_length, "au": au_length, "png": png_length, "gif": gif_length, "jpeg": jpeg_length, "bmp": bmp_length}
_FOUND: list[ahocorasick.Automaton] = []


def items(b: bytes) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of the valid items, none inside another."""
    if not _FOUND:
        _FOUND.append(automaton())
    out, free = [], 0
    for last, (kind, size) in _FOUND[0].iter(b.decode("latin-1")):
        at = last - size + 1
        if at >= free and (n := VALID[kind](b, at)):
            out.append((kind, at, n))
            free = at + n
    return out


def encode_wav(samples: bytes) -> bytes:
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def encode_au(samples: bytes) -> bytes:
    return struct.pack(">4s5I", b".snd", 24, len(samples), 2, 8000, 1) + samples


def encode_png(samples: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH * 3)
    rows = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1)  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(kind: str, b: bytes) -> tuple[bytes, str]:
    """Samples and shape of an item that `store` can have written; of others, its bytes."""
    if kind == "wav":
        p = 12
        while b[p : p + 4] != b"data":
            p += 8 + (n := int.from_bytes(b[p + 4 : p + 8], "little")) + n % 2
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        return b[p + 8 : p + 8 + n], f"{n}"
    if kind == "au":
        head, n = struct.unpack(">II", b[4:12])
        return b[head : head + n], f"{n}"
    if kind == "png":
        width, height, depth, color, _, _, lace = struct.unpack(">IIBBBBB", b[16:29])
        p, data = 8, []
        while p + 12 <= len(b):
            n = int.from_bytes(b[p : p + 4], "big")
            if b[p + 4 : p + 8] == b"IDAT":
                data.append(b[p + 8 : p + 8 + n])
            p += 12 + n
        if (depth, color, lace) == (8, 2, 0):
            rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + 3 * width)
            if not rows[:, 0].any():
                return rows[:, 1:].tobytes(), f"{width}x{height}"
    return b, f"{len(b)}"


def padded(text: bytes) -> bytes:
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, declared (a media type that says nothing), media (binary)."""
    writers = (encode_wav, encode_au, encode_png)

    def write(batches):
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text or b""
                payload = padded(raw)
                sizes.append(len(raw))
                media.append(writers[zlib.crc32(payload) % len(writers)](payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(["application/octet-stream"] * len(media), pa.string()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "declared", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_t"))
    return slim.mapInArrow(write, f"`{id_col}` {kind}, n_bytes long, declared string, media binary")


SNIFFED = (
    "media_type string, corrected boolean, embedded array<struct<media_type: string, offset: long, length: long>>, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def sniff(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns in `keep`, the type by content, whether that corrects the declared one, what is embedded
    (offsets to carve by), and digests and features of the samples read back."""

    def read(batches):
        for batch in batches:
            out = []
            for b, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b is None:
                    out.append([None] * 9)
                    continue
                found = items(b)
                whole = found[0] if found and found[0][1] == 0 else None
                samples, shape = decode(whole[0], b[: whole[2]]) if whole else (b, f"{len(b)}")
                rest = found[1:] if whole else found
                kind = MIME[whole[0]] if whole else None
                x = np.frombuffer(samples, np.uint8)
                stats = f"{x.min()}-{x.max()}:{int(x.sum(dtype=np.int64)) // len(x)}:{np.count_nonzero(np.bincount(x, minlength=256))}" if len(x) else "-"
                out.append([
                    kind, kind is not None and kind != declared, [{"media_type": MIME[k], "offset": at, "length": n} for k, at, n in rest],
                    len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(b), hashlib.sha256(b).hexdigest(),
                    f"{kind}:{shape}:{stats}:{len(rest)}",
                ])
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            embedded = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            kinds = [pa.string(), pa.bool_(), embedded, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in "media_type corrected embedded payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(3 + i) for i in range(len(keep))), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                names=[id_col, *keep, *names],
            )

    slim = media.select(F.col(id_col), F.col(media_col).alias("_m"), F.col(declared_col).alias("_d"), *keep)
    fields = "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    return slim.mapInArrow(read, fields + SNIFFED)


def media_features(docs: DataFrame) -> DataFrame:
    out = sniff(store(docs), keep=("n_bytes",))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", F.size("embedded").alias("n_embedded"))
