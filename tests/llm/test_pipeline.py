import re

import corpus_pipeline
from factloom.llm import decontaminate, lines, quality, simhash


def test_stages_of_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns, name
        now = {r["doc_id"]: r["text"] for r in after.collect()}
        assert now.keys() <= before.keys()
        if name == "quality_classifier":
            good = {r["doc_id"] for r in quality.query(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            assert now.keys() == good
        elif name == "line_dedup":
            expected = brute_lines(before)
            assert now == expected
        elif name == "simhash_near_dedup":
            assert now.keys() == brute_near_copies(before)
        else:
            hit = {r["doc_id"] for r in decontaminate.query(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
            assert now.keys() == before.keys() - hit
        kept = spark.createDataFrame(after.toPandas(), docs.schema)
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {r["doc_id"] for r in last} == before.keys() and all(r["round_trip"] for r in last)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()} == {r["doc_id"]: r["ids"] for r in last}


def brute_lines(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate(low)
    where = {}
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(k)
    gone = lambda k, x: len(key(x)) >= 20 and len(where[key(x)]) >= 3 and k != max(where[key(x)])
    return {k: "\n".join(x for x in t.split("\n") if not gone(k, x)) if t is not None else None for k, t in texts.items()}


def brute_near_copies(texts):
    """The smallest id of each component of pairs whose sets of five-word shingles have a similarity of 0.8 or more, all pairs compared."""
    sets, root = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in texts.items()}, {k: k for k in texts}
    for b in sorted(sets):
        for a in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= 0.8 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_stages_take_an_empty_table(spark, sf, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    assert lines.line_dedup(none).count() == 0
