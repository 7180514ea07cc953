import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from factloom.llm import components, decontaminate, lines, simhash, suffixes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_bytes(texts, length=100):
    seen, out = set(), {}
    for k, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=int)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(raw[p : p + length])
        hit = np.cumsum(gone)[: len(raw)] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~hit])
        out[k] = (len(raw), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [20_000, 2])
def test_suffix_dedup_against_brute_force(spark, odd_texts, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_LIMIT", limit)
    if limit == 2:  # hot k-grams at once
        monkeypatch.setattr(suffixes, "HOT_ROWS", 2)
        monkeypatch.setattr(suffixes, "HOT_SHARE", 10**9)
        monkeypatch.setattr(suffixes, "SEEN_OFTEN", 2)
    rng = random.Random(4)
    chunk = ["".join(rng.choices("abcdefghij ", k=rng.randint(60, 260))) for _ in range(20)]
    texts = list(enumerate(odd_texts + ["".join(rng.choices(chunk, k=4)) for _ in range(40)] + [chunk[0] * 5, "q" * 700, "xy" * 300, "z" * 99, "w" * 100 + "v" + "w" * 100]))
    docs = spark.createDataFrame(texts + [(None, "w" * 300)], "doc_id long, text string")
    rows = suffixes.query(docs).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] is not None}
    assert got == repeated_bytes(texts)
    assert len(rows) == len(texts) + 1


def test_suffix_family_is_opened_again(spark, odd_texts):
    """Batches of ascending ids added call by call give what one call gives; earlier documents are looked up, not changed."""
    from factloom.llm.arrow_rows import shared_folder

    rng = random.Random(6)
    chunk = ["".join(rng.choices("abcdefghij ", k=rng.randint(80, 260))) for _ in range(12)]
    texts = list(enumerate(odd_texts[10:40] + ["".join(rng.choices(chunk, k=3)) for _ in range(30)]))
    expected, folder = repeated_bytes(texts), shared_folder(spark, "suffix-family")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got, cuts = {}, [0, 20, 35, 50, 60]
    for low, high in zip(cuts, cuts[1:], strict=False):
        out = suffixes.suffix_dedup(frame(texts[low:high]), batches=1, folder=folder, earlier=frame(texts[:low]) if low else None).collect()
        got |= {r["doc_id"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == expected
    assert sorted(level for level, _ in suffixes.SuffixFamily(spark, 100, folder).levels.runs) == [0, 0, 1]
    with pytest.raises(ValueError):
        suffixes.suffix_dedup(frame(texts[:3]), folder=folder, earlier=frame(texts))


def test_suffix_dedup_of_nothing(none, odd, clashing):
    assert suffixes.query(none).count() == 0
    assert {tuple(r) for r in suffixes.query(odd).collect()} == {tuple(r) for r in suffixes.query(clashing).collect()}


def brute_components(ids, fps, total):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(fps[a], fps[b], strict=True)) <= total:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit,words,bits,budget,blocks,total", [(20_000, 1, 64, 2, 4, 2), (20, 1, 64, 2, 4, 2), (20, 2, 32, 1, 3, 100)])
def test_trie_join_against_all_pairs(spark, limit, words, bits, budget, blocks, total, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    rng = random.Random(limit + words)
    centres = [[rng.getrandbits(64) for _ in range(words)] for _ in range(12)]
    fps = {}
    for k in range(220):
        f = list(rng.choice(centres[:3] if k % 2 else centres))
        for _ in range(rng.randint(0, 4)):
            f[rng.randrange(words)] ^= 1 << rng.randrange(64)
        fps[k] = [signed(x) for x in f]
    first = {}
    for k, f in fps.items():
        first.setdefault(tuple(f), k)
    rows = spark.createDataFrame([(list(f), k) for f, k in first.items()], "fp array<long>, rep long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(rows, simhash.Tries(words, bits, budget, blocks), total)).collect()}
    ids = sorted(first.values())
    if words == 1:
        expected = brute_components(ids, fps, total)
    else:  # linked if some part differs in at most budget bits
        root = {i: i for i in ids}
        parts = lambda f: [(x & (1 << 64) - 1) >> s & (1 << 32) - 1 for x in f for s in (0, 32)]
        near = lambda a, b: any(bin(x ^ y).count("1") <= budget for x, y in zip(parts(fps[a]), parts(fps[b]), strict=True))
        changed = True
        while changed:
            changed = False
            for a in ids:
                for b in ids:
                    if near(a, b) and root[a] != root[b]:
                        root[a] = root[b] = min(root[a], root[b])
                        changed = True
        expected = root
    assert {i: roots.get(i, i) for i in ids} == expected


def plain_links(sets, asks, least):
    """Classes over all pairs of which one asks at least."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if (asks[i] or asks[j]) and (not a and not b or len(a & b) >= least * len(a | b) > 0):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_links_of_a_cell_against_all_pairs():
    make = lambda *parts: np.unique(np.concatenate([np.arange(a, b) for a, b in parts]))
    c, x, z = make((0, 100)), make((5, 105)), make((12, 112))  # x is near to both, c and z are not near each other; z does not ask
    asks = np.array([True, True, True, False])
    assert simhash.set_links([c, c, x, z], asks, 0.82).tolist() == plain_links([c, c, x, z], asks, 0.82) == [0, 0, 0, 0]
    rng = random.Random(6)
    for _ in range(300):
        base = [rng.sample(range(300), 40) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(1, 14)):
            own = list(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(40)] = rng.randrange(300)
            sets.append(np.unique(np.array(own if rng.random() < 0.95 else [], dtype=np.int64)))
        asks = np.array([rng.random() < 0.5 for _ in sets])
        got, want, full = simhash.set_links(sets, asks, 0.8).tolist(), plain_links(sets, asks, 0.8), plain_links(sets, [True] * len(sets), 0.8)
        same = lambda root: {(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]}  # noqa: E731, B023
        assert same(want) <= same(got) <= same(full)  # all links that are asked for, and none that is not there


def test_fingerprints_by_the_rule(odd, odd_texts):
    rows = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(odd).collect()}
    for k, t in enumerate(odd_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert rows[k] == [signed(expected)], k


def test_simhash_query(spark, odd, odd_texts, none, clashing):
    assert simhash.query(none).count() == 0
    rows = simhash.query(odd).collect()
    fps = {r["doc_id"]: [int(r["fingerprint"], 16)] for r in rows if r["doc_id"] is not None}
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == brute_components(sorted(fps), fps, 2)
    assert {tuple(r) for r in rows} == {tuple(r) for r in simhash.query(clashing).collect()}
    assert spark.range(1).selectExpr("xxhash64('the cat sat')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"the cat sat", 42)


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    rows, k = [], 0
    for g in range(15):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
        for copy in range(4):
            own = list(words)
            for _ in range(copy):
                own[rng.randrange(200)] = "edited"
            rows.append((k, " ".join(own), g))
            k += 1
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, g int")).collect()
    assert sorted(r["g"] for r in kept) == list(range(15)) and all(r["doc_id"] % 4 == 0 for r in kept)


@pytest.mark.parametrize("rows", [4096, 5])
def test_near_copies_are_those_of_similar_shingle_sets(spark, rows, monkeypatch):
    """Pairs on both sides of 0.8, a large group of copies of a copy, and long texts of one repeated form that share little else."""
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    monkeypatch.setattr(simhash, "LEADERS", min(rows, 32))
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for g in range(60):
        words = [word() for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(4, 196, 6), 3 + g % 8):
            other[at] = word()
        texts += [" ".join(words), " ".join(other)]
    first = len(texts)
    hot = [[word() for _ in range(200)]]
    for k in range(60):
        other = list(hot[k // 4 if k % 2 else 0])
        for at in rng.sample(range(4, 196, 6), rng.randint(1, 6)):
            other[at] = word()
        hot.append(other)
    texts += [" ".join(w) for w in hot] + [texts[0]]
    form = [word() for _ in range(12)]
    texts += [" ".join([*(word() for _ in range(200)), *form * 60]) for _ in range(2)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if near(sets[a], sets[b]):
                root = [root[a] if x == root[b] else x for x in root]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(root) and 60 < len(set(root)) < 182 and 1 < len(set(root[first : first + 61])) < 61


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(24)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 25)}, 100: 90, 95: 90}
    assert components.components(links.limit(0)).count() == 0


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if hasattr(df, "toPandas") else df)
    rel = con.sql(sql)
    return {tuple(dict(zip(rel.columns, r, strict=True))[c] for c in sorted(rel.columns)) for r in rel.fetchall()}


def rows_of(df):
    return {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}


def test_lines_against_sql(spark, odd, none, clashing):
    docs = odd.where("doc_id IS NOT NULL")
    assert rows_of(lines.query(docs)) == oracle(lines.ORACLE, documents=docs.select("doc_id", "text"))
    assert lines.query(none).count() == 0
    out = lines.line_dedup(clashing)
    assert out.count() == odd.count() and {r["n_lines"] for r in out.collect()} != {"mine"}
    assert out.where("doc_id IS NULL").first()["text"] == "no id here"


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    """A document counts once for a line, whatever the number of its rows."""
    line = "a line of twenty characters at least"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.query(docs).collect()} == {0}
    more = docs.union(spark.createDataFrame([(3, line), (3, line)], docs.schema))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in lines.query(more).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    odd = docs.selectExpr("*", "'mine' AS __text", "'mine' AS __gone", "'mine' AS key")
    assert {r["__gone"] for r in lines.line_dedup(odd).collect()} == {"mine"}


def test_a_hot_line_is_dropped_without_a_join_on_it(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_ROWS", 3)
    monkeypatch.setattr(lines, "HOT_SHARE", 10**9)
    texts = [(k, f"a line that all documents have\nand this one has {k // 3} three of them") for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(lines.query(docs)) == oracle(lines.ORACLE, documents=docs)


def test_line_runs_compact_and_open_again(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for b in range(5):
        keys = spark.createDataFrame([(b * 10 + k, bytes([k])) for k in range(4)] + [(b, bytes([50 + b]))], "doc_id long, key binary")
        assert {bytes(r["key"])[0] for r in lines.new_lines(runs, keys).collect()} == ({50 + b} if b else {0, 1, 2, 3, 50})
        runs.add(keys)
        runs = lines.LineRuns(spark, runs.levels.folder, fanout=2)
    assert sorted(level for level, _ in runs.levels.runs) == [0, 2]
    plan = runs.levels.tables()[0].hint("merge").join(runs.levels.tables()[1], "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sum(r["new"] for t in runs.levels.tables() for r in t.collect()) == 9
    spark.sql(f"DROP TABLE {runs.levels.runs[0][1]}")  # another session does not know the table
    runs = lines.LineRuns(spark, runs.levels.folder)
    expected = {(k, 5, 40 + k) for k in range(4)} | {(50 + b, 1, b) for b in range(5)}
    got = lambda least: {(bytes(r["key"])[0], r["n_docs"], r["last_doc"]) for r in runs.frequent(least).collect()}
    assert got(1) == expected and got(3) == {x for x in expected if x[1] >= 3} and got(99) == set()
    runs.levels.close()


def test_lines_batch_by_batch_equal_one_call(spark, odd):
    from factloom.llm.arrow_rows import shared_folder

    docs, folder = odd.where("doc_id IS NOT NULL"), shared_folder(spark, "line-family")
    whole = {r["doc_id"]: tuple(r) for r in lines.line_dedup(docs.select("doc_id", "text")).collect()}
    lines.line_dedup(docs.where("doc_id % 2 = 0"), folder=folder).count()
    second = docs.where("doc_id % 2 = 1").select("doc_id", "text")
    assert {r["doc_id"]: tuple(r) for r in lines.line_dedup(second, folder=folder).collect()} == {k: v for k, v in whole.items() if k % 2}


@pytest.fixture(scope="module")
def benchmark(spark, odd_texts):
    long = [t for t in odd_texts if t and len(t.split()) > 20]
    items = [(0, " ".join(long[0].split()[3:18]).upper()), (1, "x"), (2, None), (3, " ... "), (4, " ".join(long[1].split()[:12])), (5, "no such words at all in any of these"), (5, " ".join(long[0].split()[3:18])), (None, "no id here")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination_against_sql(odd, none, benchmark, block, monkeypatch):
    monkeypatch.setattr(decontaminate.find, "__defaults__", (10, "doc_id", "text", block))
    docs, items = odd.where("doc_id IS NOT NULL"), benchmark.where("item_id IS NOT NULL")
    expected = oracle(decontaminate.ORACLE, documents=docs.select("doc_id", "text"), benchmark=items)
    got = rows_of(decontaminate.query(docs, benchmark))
    assert got == expected
    hit = {r["doc_id"] for r in decontaminate.query(docs, benchmark).collect() if r["contaminated"]}
    kept = decontaminate.decontaminate(docs, benchmark, block_bytes=block)
    assert hit and kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - hit
    assert decontaminate.query(none, benchmark).count() == 0 and not decontaminate.query(docs, items.limit(0)).where("contaminated").count()


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_rows_are_answered_by_themselves_at_any_number_of_blocks(spark, block):
    w = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(w[:15])), (1, "clean"), (None, " ".join(w[20:35])), (None, None), (2, "x " + " ".join(w[:15]) + " y"), (1, " ".join(w[:15]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS __found", "'mine' AS __text")
    items = [(k, " ".join(w[k : k + 12])) for k in range(28)] + [(99, "x y"), (100, "x")]
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, items, block_bytes=block).collect()
    assert sorted((r["doc_id"] or 0, len(r["hits"]), len(r["items"])) for r in found) == [(0, 0, 0), (0, 15, 8), (1, 0, 0), (1, 15, 6), (1, 15, 6), (2, 16, 7)]
    # words are looked for in the text as it came: "x y" is no window of it
    cut = decontaminate.decontaminate(docs, items, remove="spans", block_bytes=block)
    assert sorted((r["text"] or "").strip() for r in cut.collect()) == ["", "", "", "", "clean", "y"] and {r["__found"] for r in cut.collect()} == {"mine"}
    assert sorted(r["text"] or "" for r in decontaminate.decontaminate(docs, items, block_bytes=block).collect()) == ["", "clean"]


def test_spans_are_removed(spark):
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, "Before, " + " ".join(words) + ". After"), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[5:20]))], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert out == {1: "Before, " + " ".join(words[:5]) + "  " + " ".join(words[20:]) + ". After", 2: "clean text"}


def test_items_without_an_id_count_as_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight"), (3, "nine"), (None, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "seven eight"), ("4", "five six"), ("10", "five six"), (None, None)], "item_id string, text string")
    for block in (decontaminate.BLOCK_BYTES, 8):
        found = {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in decontaminate.find(docs, items, size=3, block_bytes=block).collect()}
        assert found == {1: (6, [0, 1, 2, 4, 5], ["10", "4", None]), 2: (2, [0, 1], [None]), 3: (1, [], []), None: (3, [0, 1, 2], [None])}
    assert rows_of(decontaminate.query(docs.where("doc_id IS NOT NULL"), items)) == oracle(decontaminate.ORACLE, documents=docs.where("doc_id IS NOT NULL"), benchmark=items)
