import hashlib
import zlib

import numpy as np
import pytest

from factloom.llm import media as M
from factloom.llm import webp as W


@pytest.mark.parametrize("trial", range(12))
def test_webp_round_trips(trial):
    rng = np.random.default_rng(trial)
    h, w = int(rng.integers(1, 20)), int(rng.integers(1, 30))
    pixels = [
        rng.integers(0, 2**32, (h, w), dtype=np.uint32), rng.choice(rng.integers(0, 2**32, 12, dtype=np.uint32), (h, w)).astype(np.uint32),
        ((np.arange(h)[:, None] * 3 + np.arange(w)[None, :] * 2).astype(np.uint32) * np.uint32(0x010101)) | np.uint32(0xFF000000), np.tile(rng.integers(0, 2**32, (1, w), dtype=np.uint32), (h, 1)),
    ][trial % 4]
    bits = int(rng.integers(2, 5))
    shape = (-(-h // (1 << bits)), -(-w // (1 << bits)))
    palette = (W.PALETTE,) if len(np.unique(pixels)) <= 256 else (W.CROSS_COLOUR, W.PREDICTOR)
    for transforms in ((), (W.SUBTRACT_GREEN,), (W.PREDICTOR,), (W.CROSS_COLOUR,), (W.PREDICTOR, W.CROSS_COLOUR, W.SUBTRACT_GREEN), palette):
        for cache in (0, 4):
            for references in (False, True):
                file = W.encode(pixels, transforms, cache, references, bits, modes=rng.integers(0, 14, shape), elements=rng.integers(0, 2**32, shape, dtype=np.uint32))
                stream, end = W.stream_of(file)
                assert end == len(file)
                assert np.array_equal(W.decode_stream(stream), pixels)


def test_hand_made_stream():
    """A 2 x 1 image written bit by bit: two literals of one red each, codes of one symbol."""
    bits = W.Bits()
    for value, n in ((0x2F, 8), (1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    for symbol in (7, 200, 3, 255):  # green, red, blue, alpha
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            bits.write(value, n)
    for value, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    assert W.decode_stream(bits.bytes()).tolist() == [[0xFFC80703] * 2]


def test_broken_files_are_refused():
    file = W.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    with pytest.raises(ValueError):
        W.stream_of(file[:-8])
    with pytest.raises(ValueError):
        W.stream_of(b"RIFX" + file[4:])
    stream, _ = W.stream_of(file)
    with pytest.raises(ValueError):
        W.decode_stream(stream[: len(stream) // 2])


def test_texts_are_stored_and_read_back(odd, odd_texts, none, clashing):
    rows = {r["doc_id"]: r for r in M.digests(odd).collect()}
    for k, t in enumerate(odd_texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert {k: r.asDict() for k, r in rows.items()} == {r["doc_id"]: r.asDict() for r in M.digests(clashing).collect()}
    assert M.digests(none).count() == 0
    twice = M.digests(odd.unionByName(odd)).collect()
    assert len(twice) == 2 * odd.count() and len({tuple(r) for r in twice}) == odd.count()


def test_equal_texts_have_equal_values_whatever_their_neighbours():
    texts = ["one text", "another " * 3000, "é" * 77, "aaaa" * 900, "".join(chr(97 + k % 20) for k in range(5000)), "0110" * 40]
    payloads = [M.padded(t)[1] for t in texts]
    together = M.store(payloads)
    assert together == [M.store([p])[0] for p in payloads]
    assert [M.samples_of(p).tobytes() for p in M.read(together)] == payloads
    assert M.store(payloads[::-1])[::-1] == together


def test_columns(odd):
    back = M.from_media(M.to_media(odd)).collect()
    for r in back:
        assert len(r["payload"]) % 64 == 0 and len(r["payload"]) >= r["n_bytes"]
        assert r["feature"].startswith("rows=")


def test_the_smallest_form_is_taken():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(200)]
    prose = " ".join(rng.choice(words, 900))
    cases = {"": 200, "short": 200, prose: 0.6 * len(prose), "01" * 2000: 200, "".join(map(str, rng.integers(0, 2, 4000))): 4000 / 6, prose[:2000] * 3: 0.25 * 6000}
    for text, most in cases.items():
        payload = M.padded(text)[1]
        stored = M.store([payload])[0]
        assert len(stored) < most and M.samples_of(M.read([stored])[0]).tobytes() == payload
    kinds = {}
    for name, samples in {"plain": b"Some quick words of a fox jumping by the lazy dog, once more", "references": prose.encode(), "palette": bytes(rng.choice([3, 9, 200], 4000).tolist()), "predictor": bytes((np.cumsum(rng.integers(0, 3, 6400)) % 256).tolist())}.items():
        payload = samples + b"\0" * (-len(samples) % 64)
        bits = W.Bits(M.stream_of(payload)[5:])
        kinds[name] = (bits.read(1), bits.read(2))
        assert M.samples_of(M.read_image(M.stream_of(payload))).tobytes() == payload
    assert kinds["palette"] == (1, W.PALETTE) and kinds["predictor"] == (1, W.PREDICTOR) and kinds["references"][0] == kinds["plain"][0] == 0
    assert len(M.stream_of(M.padded(prose)[1])) < len(M.plain_stream(np.frombuffer(M.padded(prose)[1], np.uint8)))


def test_long_texts_are_whole_images():
    rng = np.random.default_rng(6)
    payload = bytes(rng.integers(97, 123, M.IMAGE_BYTES + 640).astype(np.uint8).tolist())
    stored = M.store([payload])[0]
    first, at = W.stream_of(stored)
    second, end = W.stream_of(stored, at)
    assert end == len(stored) and M.samples_of(M.read([stored])[0]).tobytes() == payload
    assert [M.read_image(x).shape for x in (first, second)] == [(1 << 14, 64), (10, 64)]
    one = W.stream_of(M.store([payload[: 1 << 16]])[0])[0]
    assert np.array_equal(M.read_image(one), W.decode_stream(one))


@pytest.mark.parametrize("trial", range(20))
def test_references_cover_what_they_repeat(trial):
    rng = np.random.default_rng(trial)
    data = rng.choice(rng.integers(0, 256, [2, 3, 8, 200][trial % 4]), 64 * int(rng.integers(1, 60))).astype(np.uint8)
    if trial > 10:
        data = np.tile(data[: len(data) // 3 + 1], 4)[: len(data)]
    end = 0
    for at, long, away in W.references(data):
        assert at >= end and 0 < away <= at and 5 <= long <= 4096
        end = at + long
        assert end <= len(data) and all(data[at + k] == data[at + k - away] for k in range(long))
    assert np.array_equal(W.decode_stream(W.byte_stream(data, 64)), M.as_pixels(data))
    values = rng.integers(1, 1 << 20, 300)
    assert [tuple(int(x) for x in row) for row in zip(*W.prefixes(values), strict=True)] == [W.prefix_of(int(v)) for v in values]
