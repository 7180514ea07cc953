"""Documents into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import base_name, paragraphs

#: Where a long paragraph may be cut, and how far into a chunk at least.
SENTENCE_END, LEAST_SHARE = re.compile(r"[。！？!?；;]"), 0.65


def split_long(text: str, max_chars: int, overlap: int) -> Iterator[str]:
    """Windows of at most max_chars, cut after the last sentence end in their final third where there is one, each stepping back by overlap."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + max_chars)
        if stop < n:
            ends = [m.end() for m in SENTENCE_END.finditer(text, at, stop) if m.end() - at >= int(max_chars * LEAST_SHARE)]
            stop = ends[-1] if ends else stop
        yield text[at:stop].strip()
        if stop == n:
            return
        at = max(at + 1, stop - overlap)


def pack(parts: list[str], max_chars: int, overlap: int) -> list[str]:
    """Short paragraphs put together up to max_chars; a new chunk begins with the end of the one before if both fit."""
    out: list[str] = []
    open_ = ""
    for part in parts:
        if len(part) > max_chars:
            out += [open_] if open_ else []
            out += split_long(part, max_chars, overlap)
            open_ = ""
        elif not open_:
            open_ = part
        elif len(open_) + 2 + len(part) <= max_chars:
            open_ += "\n\n" + part
        else:
            out.append(open_)
            carried = open_[-overlap:] + "\n\n" + part if overlap else part
            open_ = carried if len(carried) <= max_chars else part
    return out + ([open_] if open_ else [])


def chunks(docs: DataFrame, max_chars: int = 1800, overlap: int = 180, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """chunk_id, doc_id, source, chunk_ix, text. A narrow step: cleaning by built-in functions, packing by a small helper."""
    if max_chars < 100 or not 0 <= overlap < max_chars:
        raise ValueError(f"chunks of {max_chars} characters with {overlap} in common: 100 at least, and less in common than that")

    @F.pandas_udf("array<string>")
    def packed(lists: pd.Series) -> pd.Series:
        return pd.Series([pack([str(x) for x in parts] if parts is not None else [], max_chars, overlap) for parts in lists])

    stem = F.regexp_replace(base_name(F.col(source_col)), r"(?<=.)\.[^.]*$", "")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), stem.alias("stem"), F.posexplode(packed(paragraphs(F.coalesce(F.col(text_col), F.lit(""))))).alias("chunk_ix", "text"))
    return rows.select(F.format_string("%s:%s:%04d", "doc_id", "stem", "chunk_ix").alias("chunk_id"), "doc_id", "source", "chunk_ix", "text")


def document_rows(chunk_table: DataFrame, pos: str = "chunk_id") -> DataFrame:
    """doc_id, source, name of the documents that chunk ids name; of several sources the last chunk's, in the order of the column pos."""
    doc = F.substring_index("chunk_id", ":", 1)
    last = chunk_table.groupBy(doc.alias("doc_id")).agg(F.max_by("source", pos).alias("source"))
    return last.select("doc_id", "source", base_name(F.col("source")).alias("name"))
