"""Secret scans: base patterns, and credentials of other places by the format likelihood of learned automata.

The base patterns label credentials of three kinds in the corpus: assigned values, access keys, hex strings. From a
sample of each kind's distinct values (those of the smallest hashes, at most `sample`) one probabilistic automaton is
learned, and one of as many ordinary runs of 8 or more characters, without those that a kind explains better. A candidate is a run of 8 or more of
`[A-Za-z0-9+/_.=-]` (points at its ends do not count) that no base span touches and that has a digit or a capital
after a small letter. It becomes a span of the kind under which it is likeliest if it is at least 2**`margin` times as
likely under that as among ordinary runs, and per symbol at most `slack` bits less likely than the least likely
hundredth of the kind's own sample is under automata that have not seen it, and has the kinds of characters (digits, small
letters, capitals, each mark) that all but a hundredth of that sample have: a number of sixteen digits is no hex string. All candidates are scored, whatever the number of labels: a kind of few values has
an automaton too, smoothed all the more; a kind without any value has none, because nothing is known of its format.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Base spans always stay. Each row is
answered by itself, so repeated rows have equal answers, and a null id is kept. Equal likelihoods go to the kind
listed first.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import id_text, map_rows, stored
from factloom.llm.automata import Automaton

KINDS = ("assign", "access", "hex")
# Fixed values of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.A | re.I), re.compile(ACCESS), re.compile(HEX)
_RUN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: What stands in for a kind: a candidate, an ordinary run.
CANDIDATE, ORDINARY = -1, -2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base matches, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def apart(runs: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Of runs in order, which touch no base span (also in order of their starts)."""
    out, k, reach = [], 0, 0
    for s, e in runs:
        while k < len(base) and base[k][0] < e:  # spans that begin before the run ends; the furthest end counts
            reach = max(reach, base[k][2])
            k += 1
        out.append(reach <= s)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be a credential and touch no base span."""
    runs = [m.span() for m in _RUN.finditer(text) if _MIXED.search(m[0])]
    return list(compress(runs, apart(runs, base)))


def scan(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and found (arrays of start, kind, end), values (of both, with kind; ORDINARY: the runs of a slice of documents that have the `sample` smallest hashes, with its last row)."""
    span = "struct<start:int,kind:int,end:int>"

    def run(cols):
        base_out, found_out, values_out, ordinary = [], [], [], set()
        for text in cols[0]:
            base = base_spans(text)
            found = candidates(text, base)
            if base:
                runs = [m.span() for m in _RUN.finditer(text)]
                ordinary.update(text[s:e] for s, e in compress(runs, apart(runs, base)))
            else:
                ordinary.update(_RUN.findall(text))
            values = [{"kind": k, "value": _ASSIGN.match(text[s:e])[2] if k == 0 else text[s:e]} for s, k, e in base]
            values += [{"kind": CANDIDATE, "value": text[s:e]} for s, e in found]
            base_out.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            found_out.append([{"start": s, "kind": CANDIDATE, "end": e} for s, e in found])
            values_out.append(values)
        if values_out:
            values_out[-1] += [{"kind": ORDINARY, "value": w} for w in sorted(ordinary, key=hashed)[:sample]]
        return [base_out, found_out, values_out]

    schema = f"base array<{span}>, found array<{span}>, values array<struct<kind:int,value:string>>"
    return map_rows(id_text(docs, id_col, text_col), run, schema, keep=["doc_id"])


def hashed(value: str) -> tuple[int, str]:
    """The order of samples: the hash as Spark's xxhash64 gives it, then the value."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h), value


def makeup(value: str) -> set[str]:
    """The kinds of characters of a value: digits, small letters and capitals are one each, any other is its own."""
    return {"0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in value}


class Formats:
    """An automaton of each kind that has values, with the least likelihood a symbol that it accepts and the kinds of characters that it asks for, and one of ordinary runs."""

    def __init__(self, samples: dict[int, list[str]], margin: float = 20.0, slack: float = 0.5, share: float = 0.01):
        self.margin, self.kinds = 0.0, {}
        for kind in range(len(KINDS)):
            if values := samples.get(kind, []):
                half = Automaton(values[::2]), Automaton(values[1::2])  # each scores what the other has learned from
                scores = sorted(half[1 - k % 2].per_symbol(v) for k, v in enumerate(values))
                has = Counter(c for v in values for c in makeup(v))
                asked = {c for c, n in has.items() if n >= len(values) - int(len(values) * share)}
                self.kinds[kind] = (Automaton(values), scores[int(len(scores) * share)] - slack, asked)
        # ordinary runs have credentials among them: those that a kind explains better than the other half of the runs go
        halves = [samples.get(ORDINARY, [])[k::2] for k in range(2)]
        for _ in range(4):
            others = [Automaton(h) for h in halves]
            halves = [[r for r in h if self.kind(r, other) < 0] for h, other in zip(halves, others[::-1], strict=True)]
        self.ordinary = Automaton(halves[0] + halves[1])
        self.margin = margin

    def kind(self, value: str, ordinary: Automaton | None = None) -> int:
        """The likeliest kind, -1 if none accepts the value."""
        best, found = (ordinary or self.ordinary).total(value) + self.margin, -1
        has = makeup(value)
        for kind, (a, floor, asked) in self.kinds.items():
            if not asked <= has:
                continue
            score = a.total(value)
            if score >= floor * (len(value) + 1) and score > best:
                best, found = score, kind
        return found


def learn(scanned: DataFrame, sample: int = 2000) -> Formats:
    """Automata from at most `sample` distinct values of each kind and as many ordinary runs: those of the smallest hashes."""
    values = scanned.select(F.explode("values").alias("v")).select("v.kind", "v.value").where(F.col("kind") != CANDIDATE)
    samples = {}
    for kind in (*range(len(KINDS)), ORDINARY):
        own = values.where(F.col("kind") == kind).select("value", F.xxhash64("value").alias("h")).distinct()
        samples[kind] = [r["value"] for r in own.orderBy("h", "value").limit(sample).collect()]
    return Formats(samples)


def find_secrets(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), kinds as in KINDS, sorted; spans holds the base ones too.

    The texts are read once; what is scored afterwards is the small table of candidates.
    """
    scanned = stored(scan(docs, sample, id_col, text_col), "secret-candidates")
    formats = docs.sparkSession.sparkContext.broadcast(learn(scanned, sample))

    def run(cols):
        out = []
        for base, found, values in zip(*cols, strict=True):
            names = [v["value"] for v in values if v["kind"] == CANDIDATE]
            more = [{"start": c["start"], "kind": k, "end": c["end"]} for c, v in zip(found, names, strict=True) if (k := formats.value.kind(v)) >= 0]
            out.append(sorted([*base, *more], key=lambda x: (x["start"], x["kind"])))
        return [out]

    some = scanned.select("doc_id", "base", F.col("base").alias("__base"), "found", "values")
    return map_rows(some, run, "spans array<struct<start:int,kind:int,end:int>>", keep=["doc_id", "base"])


def listed(spans: str):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )
