"""Byte-level BPE encoding and decoding by merge replay with an inverted index.

The distinct pre-tokens of a slice of documents that the worker has not met yet are laid out in one array of positions.
An inverted index holds, for each merge, the positions where its token pair stands; merges are applied in rank order
over all these words at once and only the neighbours that a merge touches are indexed again. A worker keeps what it has
encoded, up to a bound, so a frequent word is merged once a worker and not once an occurrence. One replay over the
distinct pre-tokens of the whole corpus gives the same ids, but its table has to meet every occurrence by a shuffle;
the README has the figures why that is left out.

Null texts count as empty; an empty text has no ids and decodes to no bytes.  Special tokens are not recognised.
Ties between equal ranks go to the leftmost pair of a word, as in the public tiktoken library. Each row is encoded by
itself, whatever its id, so repeated rows have equal ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import id_text, map_rows

#: A vocabulary file beyond this size is not broadcast but refused; public ones have 1 to 5 MB.
MAX_VOCABULARY_BYTES = 64 << 20
#: Encoded space-delimited pieces that a worker remembers; beyond, it keeps those of the batch at hand.
MEMORY_PIECES = 250_000
#: Below so many positions, and beyond so many ranks, merges are replayed one position after another.
FEW_POSITIONS, FREQUENT_RANKS = 20_000, 12_000


class Vocabulary:
    """tokens: bytes by id; pairs: left id * size + right id -> rank; result: token id by rank."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], int], result: dict[int, int]):
        self.size = max(tokens, default=0) + 1
        self.tokens = tokens
        self.pairs = {a * self.size + b: r for (a, b), r in pairs.items()}
        self.result = result
        single = {t: i for i, t in tokens.items() if len(t) == 1}
        self.byte_ids = np.array([single[bytes([b])] for b in range(256)], dtype=np.int64)
        single_pairs = [(a, b, self.pairs.get(int(self.byte_ids[a]) * self.size + int(self.byte_ids[b]), -1)) for a in range(256) for b in range(256)]
        self.byte_ranks = np.array([r for _, _, r in single_pairs], dtype=np.int64).reshape(256, 256)
        made = {t: r for r, t in result.items()}
        #: ranks whose token can stand in a pair that does not rank higher than the token's own merge
        self.unsafe = {made[t] for (a, b), r in pairs.items() for t in (a, b) if made.get(t, -1) >= r}
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.key_ranks = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of many pairs, -1 where none merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)


def ranked_tokens(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def from_ranks(raw: bytes) -> Vocabulary:
    """Lines of base64 token and rank: any two neighbours whose bytes together are a token can merge."""
    ids = ranked_tokens(raw)
    pairs = {}
    for token, rank in ids.items():
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                pairs[a, b] = rank
    return Vocabulary({i: t for t, i in ids.items()}, pairs, {i: i for i in ids.values()})


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies in JSON use: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def from_merges(raw: bytes) -> Vocabulary:
    """A byte-level BPE of the tokenizers library: only the listed merges apply, in the order of the list."""
    model, symbols = json.loads(raw)["model"], byte_symbols()
    vocab = {k: v for k, v in model["vocab"].items() if all(c in symbols for c in k)}
    pairs, result = {}, {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs[vocab[a], vocab[b]] = rank
        result[rank] = vocab[a + b]
    return Vocabulary({v: bytes(symbols[c] for c in k) for k, v in vocab.items()}, pairs, result)


@lru_cache(maxsize=4)
def vocabulary(raw: bytes, kind: str) -> Vocabulary:
    return from_ranks(raw) if kind == "ranks" else from_merges(raw)


@lru_cache(maxsize=4)
def token_bytes(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and by id where a token begins and how long it is."""
    tokens = {i: t for t, i in ranked_tokens(raw).items()} if kind == "ranks" else from_merges(raw).tokens
    listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    lengths = np.array([len(t) for t in listed], dtype=np.int64)
    return np.frombuffer(b"".join(listed), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def read_vocabulary(path: str) -> tuple[bytes, str]:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes is not broadcast")
    return raw, "merges" if path.endswith(".json") else "ranks"


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Token ids of each non-empty word: all merges in rank order over all words together."""
    flat, cuts = replay_flat(words, v)
    flat, cuts = flat.tolist(), cuts.tolist()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def replay_flat(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All words' token ids in one int32 array, and where each word's begin (one more than there are words)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    n, ends = len(flat), np.cumsum(lengths)
    # a position's pair is itself and its right neighbour; a word's last position has none
    tok = v.byte_ids[flat]
    rank_at = np.full(n, -1, dtype=np.int64)
    rank_at[:-1] = v.byte_ranks[flat[:-1], flat[1:]]
    rank_at[ends - 1] = -1
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    right[ends - 1] = -1
    left[ends - lengths] = -1
    index: dict[int, list] = {}
    heap: list[int] = []
    add_to_index(index, heap, np.arange(n), rank_at)
    words_of = np.repeat(np.arange(len(words)), lengths)
    if n >= FEW_POSITIONS:
        odd = replay_wide(v, index, heap, tok, rank_at, left, right, words_of)
        # the words that need the order within them start again from their bytes
        at = np.flatnonzero(odd[words_of])
        tok[at] = v.byte_ids[flat[at]]
        rank_at[at[:-1]] = v.byte_ranks[flat[at[:-1]], flat[at[1:]]]
        right[at], left[at] = at + 1, at - 1
        right[ends[odd] - 1], left[(ends - lengths)[odd]] = -1, -1
        rank_at[ends[odd] - 1] = -1
        # what has gone needs no place any more
        live = np.flatnonzero(tok >= 0)
        place = np.cumsum(tok >= 0) - 1
        tok, rank_at, words_of = tok[live], rank_at[live], words_of[live]
        right, left = (np.where(x[live] >= 0, place[x[live]], -1) for x in (right, left))
        index, heap = {}, []
        add_to_index(index, heap, np.arange(len(live)), rank_at)
    lists = [a.tolist() for a in (tok, rank_at, left, right)]
    replay_narrow(v, {r: np.concatenate(p).tolist() for r, p in index.items()}, heap, *lists)
    alive = np.array(lists[0], dtype=np.int32)
    live = alive >= 0
    counts = np.bincount(words_of[live], minlength=len(words))
    return alive[live], np.concatenate([[0], np.cumsum(counts)])


def add_to_index(index: dict[int, list], heap: list[int], positions: np.ndarray, ranks: np.ndarray) -> None:
    """File positions under their ranks (below zero: no merge)."""
    order = np.argsort(ranks, kind="stable")
    order = order[np.searchsorted(ranks[order], 0) :]
    if not len(order):
        return
    ranks, positions = ranks[order], positions[order]
    starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
    bounds = [*starts.tolist(), len(ranks)]
    for r, a, b in zip(ranks[starts].tolist(), bounds, bounds[1:], strict=False):
        if r in index:
            index[r].append(positions[a:b])
        else:
            index[r] = [positions[a:b]]
            heapq.heappush(heap, r)


def replay_wide(v: Vocabulary, index, heap, tok, rank_at, left, right, words_of) -> np.ndarray:
    """Merges of the FREQUENT_RANKS first ranks, all positions of a rank at once.

    Returns which words are left out: those where two merges of one rank overlap, or where a merge brings up a
    pair that does not rank lower than itself; in these the order within the word counts.
    """
    odd = np.zeros(words_of[-1] + 1, dtype=bool)
    while heap and heap[0] < FREQUENT_RANKS:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(r)))
        at = at[(rank_at[at] == r) & ~odd[words_of[at]]]
        new = v.result[r]
        clash = rank_at[right[at]] == r
        if r in v.unsafe:
            after, before = right[right[at]], left[at]
            clash |= not_lower(v, r, np.full(len(at), new), tok[after], after)
            clash |= not_lower(v, r, tok[before], np.full(len(at), new), before)
            if -1 < v.pairs.get(new * v.size + new, -1) <= r:
                clash[:] = True
        if clash.any():
            odd[words_of[at[clash]]] = True
            at = at[~odd[words_of[at]]]
        if not len(at):
            continue
        gone = right[at]
        tok[at] = new
        tok[gone] = -1
        rank_at[gone] = -1
        after = right[gone]
        right[at] = after
        left[after[after >= 0]] = at[after >= 0]
        before = left[at]
        touched = np.concatenate([at, before[before >= 0]])
        other = right[touched]
        ranks = np.where(other >= 0, v.lookup(tok[touched], tok[other]), -1)
        rank_at[touched] = ranks
        add_to_index(index, heap, touched, ranks)
    return odd


def not_lower(v: Vocabulary, r: int, a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
    ranks = v.lookup(a, b)
    return (there >= 0) & (ranks >= 0) & (ranks <= r)


def replay_narrow(v: Vocabulary, index, heap, tok, rank_at, left, right) -> None:
    """The same, one position after another, leftmost first."""
    get, size, result = v.pairs.get, v.size, v.result
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        r = pop(heap)
        at = index.pop(r)
        at.sort()
        new = result[r]
        for k, i in enumerate(at):
            if rank_at[i] != r:
                continue
            j = right[i]
            tok[i] = new
            tok[j] = rank_at[j] = -1
            after = right[i] = right[j]
            lowest = r + 1
            if after >= 0:
                left[after] = i
                m = rank_at[i] = get(new * size + tok[after], -1)
                if m >= 0:
                    if m in index:
                        index[m].append(i)
                    else:
                        index[m] = [i]
                        push(heap, m)
                    lowest = m
            else:
                rank_at[i] = -1
            before = left[i]
            if before >= 0:
                m = rank_at[before] = get(tok[before] * size + new, -1)
                if m >= 0:
                    if m in index:
                        index[m].append(before)
                    else:
                        index[m] = [before]
                        push(heap, m)
                    if m < lowest:
                        lowest = m
            if lowest <= r:  # a lower or equal rank has come up: it goes first, the rest waits its turn
                if r in index:
                    index[r] += at[k + 1 :]
                else:
                    index[r] = at[k + 1 :]
                    push(heap, r)
                break


# Fixed value: the pattern of the public byte-level vocabularies, in which a single space before a word begins its match.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """text cut at each single space between two characters that are not white space.

    No match of SPACE_LED crosses such a place: the space can only begin the match that follows.
    """
    if _DOUBLE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _CUT.split(text)
    return text.split(" ")


class Memory:
    """What a worker remembers: the ids (int32 bytes) of pieces that follow a space (later) and of those that begin a text
    (first); for a pattern that is not SPACE_LED, of matches (later)."""

    def __init__(self, v: Vocabulary, pattern: str):
        self.v, self.find, self.space_led = v, regex.compile(pattern).findall, pattern == SPACE_LED
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def learn(self, rows: list[list[str]]) -> None:
        heads = {row[0] for row in rows}
        if len(self.first) + len(self.later) > MEMORY_PIECES:
            used = set(chain.from_iterable(rows))
            self.later = {p: x for p, x in self.later.items() if p in used}
            self.first = {p: x for p, x in self.first.items() if p in heads}
        later, first = self.later, self.first
        new = [p for p in set(chain.from_iterable(rows)) if p not in later]  # a text's first piece may follow a space elsewhere
        cut = [(later, p, self.find(" " + p)) for p in new] + [(first, p, self.find(p)) for p in heads if p not in first]
        words = {w for _, _, ws in cut for w in ws}
        known = self.values(list(words))
        for into, p, ws in cut:
            into[p] = known[ws[0]] if len(ws) == 1 else self.join(map(known.__getitem__, ws))

    join = staticmethod(b"".join)

    def values(self, words: list[str]) -> dict[str, object]:
        """What is remembered of each pre-token."""
        flat, cuts = replay_flat([w.encode() for w in words], self.v)
        flat, cuts = flat.tobytes(), (cuts * 4).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    def learn_matches(self, rows: list[list[str]]) -> None:
        if len(self.later) > MEMORY_PIECES:
            used = set(chain.from_iterable(rows))
            self.later = {p: x for p, x in self.later.items() if p in used}
        self.later.update(self.values([w for w in set(chain.from_iterable(rows)) if w not in self.later]))

    def encode(self, texts: list[str]) -> pa.ListArray:
        if self.space_led:
            rows = [pieces(t) for t in texts]
            self.learn(rows)
            first, later = self.first, self.later.__getitem__
            ids = [first[r[0]] + b"".join(map(later, r[1:])) for r in rows]
        else:
            rows = [self.find(t) for t in texts]
            self.learn_matches(rows)
            ids = [b"".join(map(self.later.__getitem__, r)) for r in rows]
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


@lru_cache(maxsize=4)
def memory(raw: bytes, kind: str, pattern: str) -> Memory:
    return Memory(vocabulary(raw, kind), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the text's tokens, each match of pattern encoded separately.

    One narrow pass: no shuffle, nothing is collected; the vocabulary (size checked) is broadcast.
    """
    raw, kind = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    return map_rows(id_text(docs, id_col, text_col), lambda cols: [memory(shared.value, kind, pattern).encode(cols[0])], "ids array<int>", keep=["doc_id"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns doc_id and ids of encoded, and decoded binary: the tokens' bytes joined (null ids: none)."""
    raw, kind = read_vocabulary(path)
    shared = encoded.sparkSession.sparkContext.broadcast(raw)

    def run(cols):
        return [join_tokens(cols[0], *token_bytes(shared.value, kind))]

    source = encoded.select("doc_id", "ids", F.col("ids").alias("__ids"))
    return map_rows(source, run, "decoded binary", keep=["doc_id", "ids"], arrow=True)


def join_tokens(ids: pa.ListArray, blob: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of each list's tokens, gathered from the vocabulary's bytes."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    long = lengths[flat]
    ends = np.cumsum(long)
    data = blob[np.repeat(begins[flat] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)]
    counts = np.array([len(x) if x.is_valid else 0 for x in ids], dtype=np.int64)
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decode()'s rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, and round_trip: whether the decoded bytes are the text's."""
    raw, kind = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def run(cols):
        ids = memory(shared.value, kind, pattern).encode(cols[0])
        back = join_tokens(ids, *token_bytes(shared.value, kind)).to_pylist()
        return [ids, np.diff(ids.offsets.to_numpy()).astype(np.int64).tolist(), [b == t.encode() for b, t in zip(back, cols[0], strict=True)]]

    return map_rows(id_text(docs, id_col, text_col), run, "ids array<int>, n_tokens long, round_trip boolean", keep=["doc_id"])
