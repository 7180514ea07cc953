"""Benchmark decontamination with a broadcast hash set of the normalised n-grams of test items.

Words are the matches of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in the text with A-Z lower-cased. A window is `size`
consecutive words of an item; an item of fewer words, but not none, is one window. Each task turns its documents'
words into numbers of the item vocabulary, hashes only windows whose words all stand in that vocabulary, looks the
hashes up, and verifies every hit word by word.

Only a block of items of bounded size is broadcast. Where the items exceed it, the rows pass one block after another
and carry what has been found so far with them, so that the number of blocks changes no result: each row is answered
by itself, null ids and repeated ids included, and words are removed after all blocks have been looked for in the text
as it came. Null texts have no words; items without words match nothing; repeated item rows count by their distinct ids.
Items without an id count as one item, which stands last among a document's items, as null; in the digest of ids it has no place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import ASCII_LOWER, drop_stored, free_name, id_text, map_rows, stored

#: Text bytes of the items that one broadcast holds.
BLOCK_BYTES = 16 << 20
#: Lower-cases A-Z and makes a space of what is no part of a word: all below 0x80 but 0-9 and a-z.
TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in ASCII_LOWER)
_WORD = re.compile(rb"[^ ]+")
_ODD = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def in_order(item: str | None) -> tuple[bool, str]:
    """The order of ids as texts, null last."""
    return item is None, item or ""


class Windows:
    """The windows of a block of items: word numbers, and by window length the known hashes and the windows' items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.numbers: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, list[str | None]]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if ids:
                n = min(size, len(ids))
                for at in range(len(ids) - n + 1):
                    window = self.by_length.setdefault(n, {}).setdefault(np.array(ids[at : at + n], dtype=np.int32).tobytes(), [])
                    if item not in window:
                        window.append(item)
        self.hashes = {n: np.unique(hashed(np.frombuffer(b"".join(ws), dtype=np.int32).reshape(-1, n))) for n, ws in self.by_length.items()}

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[list[str | None]]]:
        """Of each text: the number of words, the indices of hit words, the items found."""
        get = self.numbers.get
        rows = [[get(w, -1) for w in words_of(t)] for t in texts]
        n_words = [len(r) for r in rows]
        starts = np.concatenate([[0], np.cumsum([n + 1 for n in n_words])])
        flat = np.full(int(starts[-1]), -1, dtype=np.int32)
        for r, s in zip(rows, starts.tolist(), strict=False):
            flat[s : s + len(r)] = r
        hit = np.zeros(len(flat) + 1, dtype=np.int32)
        items: list[set[str | None]] = [set() for _ in texts]
        known = np.concatenate([[0], np.cumsum(flat >= 0)])
        for n, windows in self.by_length.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            at = at[np.isin(hashed(flat[at[:, None] + np.arange(n)]), self.hashes[n])] if len(at) else at
            owner = np.searchsorted(starts, at, side="right") - 1
            for p, k in zip(at.tolist(), owner.tolist(), strict=True):
                if found := windows.get(flat[p : p + n].tobytes()):
                    items[k].update(found)
                    hit[p] += 1
                    hit[p + n] -= 1
        hit = np.cumsum(hit) > 0
        return n_words, [np.flatnonzero(hit[s : s + n]) for s, n in zip(starts.tolist(), n_words, strict=False)], [sorted(x, key=in_order) for x in items]


def hashed(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), dtype=np.uint64)
    for column in windows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(_ODD)
        h ^= h >> np.uint64(29)
    return h


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items (id as text, text), a block of about block_bytes of text at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r[0], r[1]) for r in block.toLocalIterator()]


def marked(docs: DataFrame, benchmark: DataFrame, size: int, text_col: str, found: str, block_bytes: int, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and `found`: struct of n_words, hits (indices of hit words) and items (sorted), over all blocks of items.

    One block is one narrow pass; before each further one the rows found so far are written, so no task holds two blocks.
    """
    spark, kind = docs.sparkSession, "struct<n_words:long,hits:array<int>,items:array<string>>"
    blocks = item_blocks(benchmark, text_col="text", block_bytes=block_bytes)
    out, block, before = docs, next(blocks), None
    while block is not None:
        then, more = next(blocks, None), found in out.columns
        shared = spark.sparkContext.broadcast(Windows(block, size))

        def run(cols, shared=shared):
            n, hits, items = shared.value.scan(cols[0])
            earlier = cols[1] if len(cols) > 1 else [None] * len(n)
            rows = zip(n, hits, items, earlier, strict=True)
            return [[{"n_words": k, "hits": sorted({*h.tolist(), *(e["hits"] if e else ())}), "items": sorted({*i, *(e["items"] if e else ())}, key=in_order)} for k, h, i, e in rows]]

        source, seen = out, free_name("__seen", docs)
        if more:
            source = out.withColumnRenamed(found, seen)
        out = map_rows(source, run, f"`{found}` {kind}", keep=keep if then is None else docs.columns, read=[text_col, seen] if more else [text_col])
        if then is not None:
            out = stored(out, "decontaminate")
            if before is not None:
                drop_stored(before)
            before = out
        block = then
    return out


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words long, hits array<int> (indices of hit words), items array<string> (sorted), for each row."""
    return marked(id_text(docs, id_col, text_col), benchmark, size, "text", "__found", block_bytes, ["doc_id"]).select("doc_id", "__found.*")


def without_words(text: str, hits: set[int]) -> str:
    """text without the hit words; what stands between two neighbouring hit words goes too."""
    raw = text.encode()
    kept, done, last = [], 0, -2
    for k, m in enumerate(_WORD.finditer(raw.translate(TO_WORDS))):
        if k in hits:
            if last != k - 1:
                kept.append(raw[done : m.start()])
            done, last = m.end(), k
    return b"".join([*kept, raw[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents, or, with remove="spans", without the words that any item's window hits; in one narrow pass where there is one block of items."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    found = free_name("__found", docs)
    out = marked(docs, benchmark, size, text_col, found, block_bytes, docs.columns)
    if remove == "documents":
        return out.where(F.size(f"{found}.hits") == 0).select(docs.columns)

    def run(cols):
        return [[without_words(t, set(f["hits"])) if f["hits"] else t for t, f in zip(*cols, strict=True)]]

    keep = [c for c in docs.columns if c != text_col]
    return map_rows(out.select(*keep, text_col, found), run, f"`{text_col}` string", keep=keep).select(docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark, size=10)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), found AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
