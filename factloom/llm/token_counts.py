"""Token counts with the whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone, once, on the driver; those that come out as one token
are proven whole and broadcast with the vocabulary. A pre-token that is such a string counts one without merging; only the others are merged. Special strings
in a text are cut out first and count one each, as the tokenizers library does by default.

Null and empty texts have no tokens. Each row is counted by itself, whatever its id. Vocabularies whose file asks for
more than byte-level pieces and plain merges (a normalizer, a prefix space, dropout and the like) are refused.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.arrow_rows import id_text, map_rows


def whole_tokens(v: bpe.Vocabulary) -> set[bytes]:
    """The vocabulary strings that, encoded alone, stay one token."""
    listed = [t for t in v.tokens.values() if t]
    return {t for t, ids in zip(listed, bpe.replay(listed, v), strict=True) if len(ids) == 1}


class Counter(bpe.Memory):
    """Remembers a number of tokens for each piece, not its ids."""

    def __init__(self, raw: bytes, whole: set[bytes]):
        super().__init__(bpe.vocabulary(raw, "merges"), bpe.SPACE_LED)
        self.whole = whole
        special = sorted((t["content"] for t in json.loads(raw).get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = special

    join = staticmethod(sum)

    def values(self, words: list[str]) -> dict[str, int]:
        """Numbers of tokens: one for proven whole tokens, by merging for the others."""
        whole, known, rest = self.whole, {}, []
        for w in words:
            if (b := w.encode()) in whole:
                known[w] = 1
            else:
                rest.append((w, b))
        _, cuts = bpe.replay_flat([b for _, b in rest], self.v)
        return known | {w: n for (w, _), n in zip(rest, np.diff(cuts).tolist(), strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        extra, parts, owner = [0] * len(texts), [], []
        for k, t in enumerate(texts):
            if self.special and any(m in t for m in self.marks):
                cut = self.special.split(t)
                extra[k] = len(cut) - 1
            else:
                cut = (t,)
            for c in cut:
                parts.append(bpe.pieces(c))
                owner.append(k)
        self.learn(parts)
        first, later = self.first, self.later.__getitem__
        for k, row in zip(owner, parts, strict=True):
            extra[k] += first[row[0]] + sum(map(later, row[1:]))
        return extra


_COUNTERS: dict[bytes, Counter] = {}


def counter(raw: bytes, whole: set[bytes]) -> Counter:
    """The worker's counter of a vocabulary."""
    if raw not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[raw] = Counter(raw, whole)
    return _COUNTERS[raw]


def check_supported(raw: bytes) -> None:
    """Raise ValueError for a vocabulary file that these counts would not follow."""
    file = json.loads(raw)
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    marks = any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if file.get("normalizer") or not byte_level or model.get("type") != "BPE" or odd or marks:
        raise ValueError("only plain byte-level BPE vocabularies are counted")


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), in one narrow pass without a shuffle."""
    raw, _ = bpe.read_vocabulary(path)
    check_supported(raw)
    shared = docs.sparkSession.sparkContext.broadcast((raw, whole_tokens(bpe.vocabulary(raw, "merges"))))

    source = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = map_rows(source, lambda cols: [counter(*shared.value).count(cols[0])], "n_tokens long", keep=["doc_id", "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
