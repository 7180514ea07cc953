"""Media columns: texts stored as lossless WebP images, read back, and features of their pixels.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are the greens of an image of ROW_BYTES pixels
a row. The format allows 16,384 rows, which are 1 MiB; a longer text is several images, one file after another, each of
which any reader of the format opens. Of the ways to store an image the smallest is taken:
- literals under one fixed code for text, which needs no code of its own;
- back-references and codes of its own, tried where a tenth of the text or more repeats, or where it is not like text;
- the same after the palette transform, which packs several pixels of few colours into one, where there are at most 16;
- the same after a predictor (left or upper pixel) where that makes the samples more even.
Colour cache and cross-colour transform have nothing to take out of images whose red and blue are always zero; the
decoder reads them all the same.

Null and empty texts are one image of zeros. Equal texts have equal values: nothing depends on their neighbours.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm import webp
from factloom.llm.arrow_rows import id_text, map_rows, sha

#: Pixels in a row (all payloads are whole rows), and bytes in one image.
ROW_BYTES, IMAGE_BYTES = 64, 64 << 14
#: Fixed weights of the prefix code for text: by group of characters, each of its members'.
WEIGHTS = {" ": 170, "e": 100, "taoinsrh": 65, "dlucm": 32, "fgpwybv": 16, "kjxqz.,\n": 6}
PLAIN, HIGH, CONTROL = 0.8, 1.0, 0.3
#: Texts below this are not worth codes of their own, which take about a hundred bytes; of the others those are tried of
#: which so much repeats, or which the code for text does not shorten to this share.
OWN_CODES, REPEATED, STRANGE = 320, 0.1, 0.75


@lru_cache(maxsize=1)
def text_code():
    """(codes and lengths by byte, the bits of the image's header after its size, how many, the code's table)."""
    weights = {b: (HIGH if b > 127 else PLAIN if b > 31 else CONTROL) for b in range(256)}
    weights |= {ord(c): w for group, w in WEIGHTS.items() for c in group}
    lengths = webp.code_lengths(weights, 14)
    codes = webp.canonical(lengths)
    bits = webp.Bits()
    bits.write(0, 3)  # no transform, no cache, no meta codes
    webp.write_code(bits, lengths, 256 + webp.LENGTH_CODES)
    for channel in (0, 0, 255):
        webp.write_code(bits, {channel: 0}, 256)
    webp.write_code(bits, {}, webp.DISTANCE_CODES)
    value, n = bits.joined()
    return np.array([codes[b][0] for b in range(256)], dtype=np.int64), np.array([codes[b][1] for b in range(256)], dtype=np.int64), value, n, webp.table_of(tuple(sorted(lengths.items())))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))


def as_pixels(samples: np.ndarray) -> np.ndarray:
    return (samples.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1, ROW_BYTES)


def entropy(samples: np.ndarray) -> float:
    """Bits a sample."""
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def stream_of(payload: bytes) -> bytes:
    """The VP8L stream of one image: the smallest of those that there is reason to try."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    _, size, _, head_bits, _ = text_code()
    counts = np.bincount(samples, minlength=256)
    best, plain = None, 5 + (head_bits + int(counts @ size) + 7) // 8
    strange = plain > STRANGE * len(samples)
    if len(samples) >= OWN_CODES and (strange or repeated(payload) >= REPEATED):
        best = webp.byte_stream(samples, ROW_BYTES)
    if best is not None and strange:
        left, upper = entropy(np.diff(samples)), entropy(samples[ROW_BYTES:] - samples[:-ROW_BYTES])
        if min(left, upper) < 0.8 * entropy(samples):
            best = min(best, transformed(samples, (webp.PREDICTOR,), mode=1 if left < upper else 2), key=len)
    if np.count_nonzero(counts) <= 16:
        packed = transformed(samples, (webp.PALETTE,))
        best = packed if best is None else min(best, packed, key=len)
    return plain_stream(samples) if best is None or len(best) >= plain else best


def repeated(payload: bytes) -> float:
    """Which share of the payload's strings of eight bytes came up before in it."""
    strings = np.sort(np.ndarray(shape=(len(payload) - 7,), dtype="<u8", buffer=payload, strides=(1,)))
    return np.count_nonzero(strings[1:] == strings[:-1]) / len(strings)


def transformed(samples: np.ndarray, transforms: tuple, mode: int = 1) -> bytes:
    pixels, block = as_pixels(samples), 9
    modes = np.full(tuple(-(-n // (1 << block)) for n in pixels.shape), mode)
    return webp.stream_of(webp.encode(pixels, transforms, references=True, block_bits=block, modes=modes))[0]


def plain_stream(samples: np.ndarray) -> bytes:
    """Literals under the code for text."""
    code, size, head, head_bits, _ = text_code()
    fours = samples.reshape(-1, 4)
    body, n = webp.packed([code[fours[:, k]] for k in range(4)], [size[fours[:, k]] for k in range(4)])
    size_bits = (ROW_BYTES - 1) | (len(samples) // ROW_BYTES - 1) << 14 | 1 << 28
    return struct.pack("<BI", 0x2F, size_bits) + (head | body << head_bits).to_bytes((head_bits + n + 7) // 8, "little")


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    return [b"".join(webp.riff(stream_of(p[k : k + IMAGE_BYTES])) for k in range(0, len(p), IMAGE_BYTES)) for p in payloads]


def read_image(stream: bytes) -> np.ndarray:
    """The pixels of a stream; one under the code for text is known by its header."""
    _, _, head, head_bits, table = text_code()
    n = (head_bits + 7) // 8
    if stream[:1] == b"\x2f" and stream[4:5] < b"\x20" and int.from_bytes(stream[5 : 5 + n], "little") & ((1 << head_bits) - 1) == head:
        return webp.decode_literals(stream, 40 + head_bits, table)
    return webp.decode_stream(stream)


def read(stored: list[bytes]) -> list[np.ndarray]:
    """The pixels of each stored form: its images one under another."""
    out = []
    for data in stored:
        at, images = 0, []
        while at < len(data):
            stream, at = webp.stream_of(data, at)
            images.append(read_image(stream))
        out.append(np.concatenate(images) if len(images) > 1 else images[0])
    return out


def samples_of(pixels: np.ndarray) -> np.ndarray:
    """The bytes that an image holds."""
    return (pixels >> np.uint32(8)).astype(np.uint8)


def feature(pixels: np.ndarray) -> str:
    """Rows, mean and deviation of the samples, share of rows that repeat the row above, and eight bins of sample values."""
    samples = samples_of(pixels)
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    same = int((pixels[1:] == pixels[:-1]).all(axis=1).sum())
    return f"rows={len(pixels)};mean={samples.mean():.3f};deviation={samples.std():.3f};same={same};bins={','.join(map(str, bins.tolist()))}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long, media binary; one narrow pass."""

    def run(cols):
        made = [padded(t) for t in cols[0]]
        return [[n for n, _ in made], store([p for _, p in made])]

    return map_rows(id_text(docs, id_col, text_col), run, "n_bytes long, media binary", keep=["doc_id"])


def from_media(media: DataFrame) -> DataFrame:
    """The columns of media, payload binary (read back) and the feature of its pixels."""
    keep = media.columns
    source = media.withColumn("__media", media["media"])

    def run(cols):
        pixels = read(cols[0])
        return [[samples_of(p).tobytes() for p in pixels], [feature(p) for p in pixels]]

    return map_rows(source, run, "payload binary, feature string", keep=keep)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, of payloads stored and read back; stored forms and payloads do not leave the worker."""

    def run(cols):
        made = [padded(t) for t in cols[0]]
        media = store([p for _, p in made])
        pixels = read(media)
        back = [samples_of(p).tobytes() for p in pixels]
        return [
            [n for n, _ in made], [len(b) for b in back], [sha(b) for b in back], [zlib.crc32(b[-64:]) for b in back],
            [len(m) for m in media], [sha(m) for m in media], [feature(p) for p in pixels],
        ]

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(id_text(docs), run, schema, keep=["doc_id"])
