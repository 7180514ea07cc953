import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import automata, hpylm, quality, queries, secrets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return (text or "").translate(LOW).encode().split() + [b"\n"]


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    sets = (["the", "of", "cat", "runs", "home", "to"], ["le", "de", "chat", "va", "maison", "et"])
    rows = [(k, " ".join(rng.choices(sets[k % 2], k=rng.randint(3, 60))) + (" rare%d" % k if k % 3 else "")) for k in range(120)]
    return spark.createDataFrame(rows + [(500, None), (501, "")], "doc_id long, text string")


@pytest.mark.parametrize("hot,own", [(1 << 15, 192), (6, 4), (1, 192)])
def test_language_model_against_plain_counts(prose, hot, own, monkeypatch):
    monkeypatch.setattr(hpylm, "HOT_WORDS", hot)
    monkeypatch.setattr(hpylm, "OWN", own)
    scored = hpylm.query(prose)
    rows = {r["doc_id"]: r for r in scored.collect()}
    texts = {r["doc_id"]: r["text"] for r in prose.collect()}
    counts = Counter(t for k, x in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for k, x in texts.items():
        own_, r = tokens(x), rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own_), sum(counts[t] > 0 for t in own_), n, zlib.crc32(str(k).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own_))
        assert r["score"] < 0
    p = hpylm.perplexity(scored.where("held_out")).first()
    held = [r for r in rows.values() if r["held_out"]]
    assert p["perplexity"] == pytest.approx(10 ** (-sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)))
    assert p["perplexity"] < 0.75 * p["base_perplexity"]


def test_scores_are_the_same_by_broadcast_and_by_shuffle(prose, monkeypatch):
    model = hpylm.learn(prose.select("text"))
    hot = {r["doc_id"]: r["score"] for r in hpylm.score(prose, model).collect()}
    model.frequent.keys = model.frequent.keys[:3]
    rare = {r["doc_id"]: r["score"] for r in hpylm.score(prose, model).collect()}
    assert hot.keys() == rare.keys() and all(hot[k] == pytest.approx(rare[k], rel=1e-9) for k in hot)


def test_own_contexts_predict_what_follows_a_word(spark):
    """After one frequent word always the same word comes, whose class has many others: only a context of its own can know."""
    rng = random.Random(1)
    rows = []
    for k in range(300):
        words = []
        for _ in range(30):
            words += ["red", "fish"] if rng.random() < 0.2 else [rng.choice(["mixed", "bred", "shared", "led"]), rng.choice(["dog", "cat", "fish", "cow", "hen"])]
        rows.append((k, " ".join(words)))
    scored = hpylm.query(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out")
    with_own = hpylm.perplexity(scored).first()["perplexity"]
    # entropy of the source: after red 0 bits, after the others log2(5), before each pair 0.2 against 0.8 / 4
    bits = (-(0.2 * math.log2(0.2) + 0.8 * math.log2(0.2)) + 0.8 * math.log2(5)) / 2
    assert with_own < 2**bits * 1.1


def test_probabilities_sum_to_one(prose):
    model = hpylm.learn(prose.select("text"))
    lp = hpylm.dense(model.seats, model.totals).toPandas()["lp"]
    known = np.array([10.0 ** np.frombuffer(x, np.float64) for x in lp]).sum(axis=0)
    # the root's base gives unknown words one share like each known word's
    assert np.allclose(known + 10.0 ** hpylm.unknown(model.totals), 1, atol=0.02)


def test_strengths_follow_the_totals():
    random_ = np.random.default_rng(3)
    assert hpylm.digamma(np.array([1.0, 10.0])) == pytest.approx([-0.5772156649, 2.2517525891])
    for strength in (2.0, 60.0):
        tables = []
        for _ in range(40):
            t = 1
            for n in range(1, 2000):
                t += random_.random() < (strength + 0.4 * t) / (strength + n)
            tables.append(t)
        drawn, at = [], 10.0
        for _ in range(60):
            at = hpylm.sampled_strength(at, 0.4, np.full(40, 2000.0), np.array(tables, dtype=float), random_)
            drawn.append(at)
        assert 0.6 < np.mean(drawn[20:]) / strength < 1.6


def test_seating_follows_the_restaurant_process():
    random_ = np.random.default_rng(0)
    n = np.full(4000, 200)
    tables, _ = hpylm.seat(n, np.full(4000, 2.0), 0.5, random_)
    t = 1.0
    for k in range(1, 200):
        t += 2.0 / (k - 0.5 * t + 2.0)
    assert abs(tables.mean() - t) / t < 0.1
    assert (hpylm.seat(np.array([0, 1]), np.ones(2), 0.5, random_)[0] == [0, 1]).all()


def test_language_model_on_odd_and_empty_tables(odd, none, clashing):
    assert hpylm.query(none).count() == 0
    twice = hpylm.query(odd.unionByName(odd)).collect()
    assert len(twice) == 2 * odd.count()
    for r in twice:
        assert r["score"] == pytest.approx(next(x["score"] for x in twice if x["doc_id"] == r["doc_id"]), rel=1e-9)
    one, two = ({r["doc_id"]: r.asDict() for r in hpylm.query(d).collect()} for d in (odd, clashing))
    assert one.keys() == two.keys() and all(one[k]["n_tokens"] == two[k]["n_tokens"] and one[k]["score"] == pytest.approx(two[k]["score"], rel=1e-6) for k in one)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(good) > 30 and np.mean(good) > 0.95 and (not bad or np.mean(bad) < 0.3)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_without_labels_and_on_odd_rows(spark, odd, none, clashing):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.query(odd, nothing).collect()} == {0.5}
    assert quality.query(none, nothing).count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    assert quality.query(clashing, labels).count() == odd.count()
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() <= odd.count()
    # rows without an id, and repeated ones, are scored each by itself
    twice = odd.unionByName(odd)
    rows = quality.query(twice, labels).collect()
    assert len(rows) == 2 * odd.count() and all(r["held_out"] for r in rows if r["doc_id"] is None)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert quality.keep_good(twice, labels).where("doc_id IS NULL").count() in (0, 2)


def test_isotonic_rises():
    knots, p = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]))
    assert (np.diff(p) > 0).all() and len(p) == 3 and abs(p[1] - 0.4) < 0.01


def test_fourier_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    m = quality.Model(np.zeros(3), np.ones(3), rng.normal(0, 0.25, (3, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))
    x = rng.normal(size=(5, 3))
    z = m.features(x)[:, 4:]
    expected = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 16))
    assert np.abs(z @ z.T - expected).max() < 0.03


def test_base_spans():
    text = "Token : 'abcdefgh' x API-KEY=12345678 api_key=short password=\"AbC/9.=-z\" AKIA12 AKIA" + "Z9" * 8 + " " + "a" * 31 + " " + "f0" * 16
    found = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.base_spans(text)]
    assert found == [("assign", "Token : 'abcdefgh"), ("assign", 'password="AbC/9.=-z'), ("access", "AKIA" + "Z9" * 8), ("hex", "f0" * 16)]
    assert secrets.base_spans("") == [] and secrets.base_spans("éé token=" + "x" * 9)[0] == (3, 0, 18)


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_automata_keep_the_shape_of_formats():
    rng = random.Random(2)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    formats = {"hex": lambda: pick("0123456789abcdef", 40), "key": lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "dotted": lambda: f"{pick(ALNUM, 12)}.{pick(ALNUM, 20)}.{pick(ALNUM, 8)}"}
    words = [pick("eeeetttaaaooinnsshrdlu", rng.randint(8, 20)) + rng.choice(["", "", "-" + pick("etaoin", 5), "." + pick("0123456789", 2)]) for _ in range(1000)]
    ordinary = automata.Automaton(words)
    for make in formats.values():
        a = automata.Automaton([make() for _ in range(200)])
        assert len(a.states) > 10  # ends and separators stand where they stand in the samples
        assert all(a.total(x) > ordinary.total(x) + 20 for x in (make() for _ in range(100)))
        x = make()
        assert a.total(x) > a.total(x[:-1]) + 3 and sum(a.total(w) > ordinary.total(w) + 20 for w in words) == 0
    loops = automata.Automaton(["ab" * int(rng.expovariate(0.2) + 1) for _ in range(2000)], depth=50)
    assert len(loops.states) < 20  # states of different depths that go on alike are one
    assert automata.Automaton([]).per_symbol("abc") < -5 and len(automata.Automaton(["x" * 100_000] * 3, depth=64).states) <= 65
    # a distribution: what can follow a state sums to one
    for stop, unseen, follow, _ in loops.states[:5] + ordinary.states[:5]:
        seen = [automata.CLASS_OF.get(c, automata.OTHER) for c in follow]
        rest = sum(2**p * (w - seen.count(k)) for k, (p, w) in enumerate(zip(unseen, automata.WIDTHS, strict=True)))
        assert abs(2**stop + rest + sum(2**p for p, _ in follow.values()) - 1) < 1e-9


@pytest.mark.parametrize("labelled", [10, 60, 400])
def test_unlabelled_credentials_are_found(spark, labelled):
    """Recall and precision of added spans: credentials of labelled formats that stand where no base pattern sees them."""
    rng = random.Random(labelled)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    make = [lambda: "ghp_" + pick(ALNUM, 36), lambda: pick(ALNUM, 24), lambda: f"{pick(ALNUM, 12)}.{pick(ALNUM, 20)}.{pick(ALNUM, 8)}"]
    sounds = ["the", "re", "on", "ing", "ti", "la", "mo", "ner", "ver", "and", "su", "per", "al", "ic", "ous", "ent", "de", "com", "ma", "is"]
    word = lambda: "".join(rng.choices(sounds, k=rng.randint(1, 6)))
    odd = lambda: rng.choice([lambda: f"{word()}s.{rng.randint(10, 99)}", lambda: f"mail{rng.randint(0, 9)}.{word()}.com", lambda: f"/usr/{word()}/{word()}{rng.randint(1, 9)}"])()
    number = lambda: rng.choice([lambda: pick("0123456789", 16), lambda: f"555-{pick('0123456789', 4)}", lambda: f"20{pick('012', 1)}{pick('0123456789', 1)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: f"+49-{pick('0123456789', 10)}"])()
    rows, planted = [], {}
    for k in range(600):
        words = [odd() if rng.random() < 0.02 else number() if rng.random() < 0.02 else word() for _ in range(rng.randint(5, 60))]
        if k < labelled:
            words.insert(3, f"token={rng.choice(make)()}")
        elif k >= 450:
            planted[k] = rng.choice(make)()
            words.insert(3, planted[k])
        rows.append((k, " ".join(words)))
    found = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(k, rows[k][1][x["start"] : x["end"]]) for k, r in found.items() for x in r["spans"] if x not in r["base"]}
    right = {(k, v) for k, v in planted.items()}
    assert len(added & right) > 0.9 * len(right) and len(added - right) <= 0.1 * len(added), (len(added & right), len(right), sorted(added - right)[:9])


def test_numbers_of_personal_data_are_no_secrets(spark):
    """Labelled hex strings of 40 characters, as in the given tables; card numbers, phone numbers, dates and addresses of machines stand about. A hex string behind a wall of capitals is found."""
    rng = random.Random(3)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    rows = [(k, f"the words token={pick('0123456789abcdef', 40)} stand here") for k in range(130)]
    rows += [(200 + k, f"call 555-{pick('0123456789', 4)} or pay by {pick('0123456789', 16)} on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} from 10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7 mail{k}@name.example.org") for k in range(300)]
    rows += [(600 + k, f"left {pick('0123456789abcdef', 20)}_{pick('0123456789abcdef', 19)}") for k in range(5)] + [(700, pick("0123456789abcdef", 40).upper().lower()[:31])]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["doc_id"] for r in found for x in r["spans"] if x not in r["base"]}
    assert not added & set(range(200, 500))


def test_runs_apart_from_base_spans():
    rng = random.Random(0)
    for _ in range(200):
        runs = sorted({(s, s + rng.randint(1, 9)) for s in rng.sample(range(200), 12)})
        base = sorted((s, 0, s + rng.randint(1, 30)) for s in rng.sample(range(200), 6))
        runs = [r for k, r in enumerate(runs) if not k or runs[k - 1][1] <= r[0]]
        assert secrets.apart(runs, base) == [not any(a < e and s < b for a, _, b in base) for s, e in runs]
    assert secrets.candidates("see hunter22xyz. or plainwords or Ab1", []) == [(4, 15)]


def test_secret_query(odd, none, clashing):
    rows = {r["doc_id"]: r for r in secrets.query(odd).collect()}
    assert sum(r["n_assign"] for r in rows.values()) == 3 and sum(r["n_access"] for r in rows.values()) == 3 and sum(r["n_hex"] for r in rows.values()) == 3
    assert {k: r.asDict() for k, r in rows.items()} == {r["doc_id"]: r.asDict() for r in secrets.query(clashing).collect()}
    assert rows[0]["spans"] == "" and secrets.query(none).count() == 0
    twice = secrets.query(odd.unionByName(odd)).collect()
    assert len(twice) == 2 * odd.count() and {tuple(r) for r in twice} == {tuple(r) for r in rows.values()}


def test_words_that_every_task_has_once_are_counted(spark):
    """Forty tasks of one text each: a word that each has once is more frequent than the words that one task has three times."""
    texts = [(" ".join(["shared", *[f"own{k}x{j}" for j in range(20) for _ in range(3)]]),) for k in range(40)]
    df = spark.createDataFrame(texts, "text string")
    key = hpylm.hash_of([b"shared"])[0]
    for parts in (40, 3):
        found = hpylm.frequent_words(df.repartition(parts))
        assert key in found.own and key in found.keys[:2]
    assert list(found.keys) == list(hpylm.frequent_words(df.coalesce(1)).keys)


def test_words_are_taken_apart_as_by_plain_python(odd_texts):
    import pyarrow as pa
    import xxhash

    texts = [*odd_texts, None, "a", "B ab ABC abcd", "end\x1f ", " \x85é ", "exactly8 and.more.than.16.bytes fifteen.bytes.x", " ".join(c * n for n in (63, 64, 65, 300) for c in "xyz"), "long" * 5_000_000 + " " + "long" * 4_999_999]
    keys, starts = hpylm.tokens(pa.array(["before", *texts]).slice(1))
    plain = [tokens(t) for t in texts]
    assert list(starts) == list(np.cumsum([0, *map(len, plain)]))
    words = [w for t in plain for w in t]
    known = dict(zip(words, keys.tolist(), strict=True))
    assert [known[w] for w in words] == keys.tolist() and len(set(known.values())) == len(known) and known.pop(b"\n") == hpylm.END
    assert hpylm.hash_of(list(known)).tolist() == list(known.values())
    assert all(k & 63 == xxhash.xxh32_intdigest(w if len(w) <= 3 else w[-2:]) % 63 + 1 for w, k in known.items())
    assert [len(x) for x in hpylm.tokens(pa.array([], pa.string()))] == [0, 1]


def test_shuffles_carry_blocks_and_no_row_for_each_token_or_pair(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "HOT_WORDS", 6)
    rng = random.Random(8)
    words = ["w%d" % k for k in range(2000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=200))) for k in range(400)], "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("lm-blocks", "")
    try:
        scored = hpylm.query(docs).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in jobs.getJobIdsForGroup("lm-blocks") for s in jobs.getJobInfo(j).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    n_tokens = sum(r["n_tokens"] for r in scored)
    assert len(scored) == 400 and n_tokens == 400 * 201 and 0 < shuffled < n_tokens / 10


def test_blocks_of_many_batches_and_tasks_add_up(spark, monkeypatch):
    """Sums that are folded, and sent off early, are those of one task; a block's words keep their own rows."""
    rng = random.Random(4)
    rows = [(" ".join("w%d" % min(rng.expovariate(0.02), 400) for _ in range(60)),) for _ in range(150)]
    df = spark.createDataFrame(rows, "text string")
    frequent = hpylm.frequent_words(df)

    def all_of(blocks):
        found = {}
        for x in hpylm.blocks_of(blocks.toArrow().to_batches()):
            ends = np.cumsum(x.width)
            for at, key in enumerate(x.key.tolist()):
                assert key not in found
                pairs = slice(ends[at] - x.width[at], ends[at])
                found[key] = (int(x.total[at]), x.ctx[pairs].tolist(), x.n[pairs].tolist())
        return found

    one = all_of(hpylm.counts(df.coalesce(1), frequent))
    assert one == all_of(hpylm.counts(df.repartition(7), frequent))
    plain = Counter(t for r in rows for t in tokens(r[0]))
    assert sorted(x[0] for x in one.values()) == sorted(plain.values()) and all(sum(x[2]) == x[0] for x in one.values())
    batches = [b for k in range(0, 150, 30) for b in df.offset(k).limit(30).toArrow().to_batches()]
    count = lambda texts: (k := np.unique(hpylm.tokens(texts)[0], return_counts=True)) and (k[0], np.zeros(len(k[0]), dtype=np.uint8), k[1])
    monkeypatch.setattr(hpylm, "FOLD_ROWS", 300)
    sent = list(hpylm.sent(iter(batches), count, 3))
    key, _, n = hpylm.received(iter(sent))
    assert len(sent) > 1 and dict(zip(key.tolist(), n.tolist(), strict=True)) == {k: x[0] for k, x in one.items()}
