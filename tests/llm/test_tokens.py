import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from factloom.llm import bpe, queries, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode_odd_texts(odd, odd_texts):
    enc = reference()
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS).collect()}
    for k, t in enumerate(odd_texts):
        assert rows[k]["ids"] == enc.encode_ordinary(t or ""), k
        assert bytes(rows[k]["decoded"]) == (t or "").encode()


def test_digests_and_empty_table(odd, none, clashing):
    for docs in (odd, clashing):
        rows = bpe.digests(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)).collect()
        assert len(rows) == odd.count()
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS)).count() == 0
    assert all(r["round_trip"] for r in bpe.encode_checked(odd, RANKS, P.PATTERN).collect())


def test_replay_wide_and_narrow_agree(monkeypatch):
    v = bpe.vocabulary(*bpe.read_vocabulary(RANKS))
    rng = random.Random(1)
    words = ["".join(rng.choices("abehtnir ioaaé", k=rng.randint(1, 12))).encode() for _ in range(8000)] + [b"a" * 50, b"ab" * 40]
    monkeypatch.setattr(bpe, "FEW_POSITIONS", 0)
    wide = bpe.replay(words, v)
    monkeypatch.setattr(bpe, "FEW_POSITIONS", 10**9)
    assert bpe.replay(words, v) == wide
    enc = reference()
    assert wide[:300] == [enc._encode_single_piece(w) for w in words[:300]]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 50)
    m = bpe.Memory(bpe.vocabulary(*bpe.read_vocabulary(RANKS)), P.PATTERN)
    enc = reference()
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(40))
        assert m.encode([text]).to_pylist() == [enc.encode_ordinary(text)]
        assert len(m.later) <= 50 + 80


def test_token_counts(odd, odd_texts, none, clashing):
    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    expected = {k: len(own.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(odd_texts)}
    for docs in (odd, clashing):
        rows = token_counts.token_counts(docs, path).collect()
        for r in rows:
            if r["doc_id"] is not None:
                assert r["n_tokens"] == expected[r["doc_id"]], r
                assert r["n_bytes"] == len((odd_texts[r["doc_id"]] or "").encode())
                assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(none, path).count() == 0


def test_other_patterns_and_repeated_rows(spark, odd, odd_texts):
    """A pattern under which a space is no part of the word after it; rows that repeat are encoded each by itself."""
    pattern = r"\S+|\s"
    enc = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    rows = bpe.encode(odd.unionByName(odd), RANKS, pattern).collect()
    assert len(rows) == 2 * odd.count()
    assert all(r["ids"] == enc.encode_ordinary(odd_texts[r["doc_id"]] or "") for r in rows if r["doc_id"] is not None)
    counted = token_counts.token_counts(odd.unionByName(odd), P.path("byte_bpe_50k.json")).collect()
    assert len(counted) == len(rows) and len({(r["doc_id"], r["n_tokens"]) for r in counted}) == odd.count()


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import pytest

    file = json.load(open(P.path("byte_bpe_50k.json")))
    token_counts.check_supported(json.dumps(file).encode())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": file["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            token_counts.check_supported(json.dumps(file | change).encode())


def test_whole_tokens_encode_alone_as_one():
    raw, kind = bpe.read_vocabulary(P.path("byte_bpe_50k.json"))
    v = bpe.vocabulary(raw, kind)
    whole = token_counts.whole_tokens(v)
    assert len(whole) > 50_000
    assert all(len(x) == 1 for x in bpe.replay(sorted(whole)[:2000], v))


def test_queries_on_tables(spark, sf):
    for name in ("op1_byte_level_bpe", "op4_token_counts"):
        assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
