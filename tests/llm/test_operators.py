"""The corpus operators on odd rows, and against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, embeddings, fingerprints, langid, mixing, nearcopies, pieces, quality, sharding, simhash, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "ONE two three four five six", "en", "b", 27), (4, "ONE two three four five six", "en", "b", 27),
    (None, "no id here", "en", None, 10), (7, "x" * 70_000, "de", "b", 70_000), (8, "a\n\nb ▁ \t 日本 🎉", "fr", "a", 12), (9, "you stupid idiot", None, "a", 16),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, predicted int, label int, ids array<int>, size long, fp long, `row_number` int"


@pytest.fixture(params=["plain", "clash", "empty"])
def odd(spark, request):
    if request.param == "plain":
        return spark.createDataFrame(ODD, SCHEMA)
    if request.param == "empty":
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame([(*r, 1.0, 1, 1, [1], 5, 6, 7) for r in ODD], SCHEMA + EXTRA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 1, 1), (3, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_simhash_odd_and_brute(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    if got:
        assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2
        assert by[1]["component_id"] == by[4]["component_id"] == 1
        words = "one two three four five six".split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
        assert by[1]["fingerprint"] == f"{want:016x}"


def test_near_copies_odd(spark, odd):
    kept = nearcopies.keep_one(odd)
    assert kept.columns == odd.columns
    if odd.count():
        # 4 repeats 1 but for case, 3 is as wordless as 2, the row without an id stays
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 7, 8, 9]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, b + " more", "x"), (None, a, "x"), (None, "c d e f g h", "x"), (None, "c d e f g h", "x")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _text string"))
    assert kept.columns == ["doc_id", "text", "_text"]
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == [(0, "c d e f g h"), (1, a), (1, b)]


def test_near_copies_share_shingles(spark):
    rng = random.Random(5)
    rows, words = [], [f"w{k}" for k in range(4000)]
    for base in range(25):
        text = rng.choices(words, k=rng.choice([30, 150, 600]))
        for _ in range(12):
            copy = list(text)
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.01, 0.02, 0.03, 0.1]))):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, parent = [set(nearcopies.shingle_hashes(t, 5).tolist()) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for i, j in linked:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert sum(got[i] == got[j] for i, j in linked) >= 0.98 * len(linked)
    assert all(root(i) == root(got[i]) for i in got)


def test_near_copies_replace_links_that_fail(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:150] + ["other"] + words[151:])), (3, " ".join(f"v{k}" for k in range(300)))]
    forest = lambda prints, *_: prints.alias("a").join(prints.where("first.doc_id = 3").alias("b"), F.expr("a.id <> b.id")).selectExpr("least(a.id, b.id) AS src", "greatest(a.id, b.id) AS dst")
    monkeypatch.setattr(nearcopies, "candidate_links", forest)
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}


def test_bitmaps_pass_every_similar_pair():
    rng, passed = np.random.default_rng(8), 0
    for n in [0, 1, 3, 17, 64, 700]:
        for m in [1, 4, 20, 64, 800]:
            every = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            for common in {0, min(n, m) // 2, min(n, m)}:
                a, b = every[:n], np.concatenate([every[:common], every[n : n + m - common]])
                may = nearcopies.may_share(nearcopies.bitmap(a), nearcopies.bitmap(b), n, m, 0.8)
                assert may or common / (n + m - common) < 0.8
                passed += may and common == 0 and n > 3
    assert not passed


def test_sketches_pass_every_similar_pair():
    rng = np.random.default_rng(9)
    every = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = [every[a:b] for a, b in [(0, 0), (0, 1), (0, 100), (5, 100), (0, 1500), (100, 1600), (0, 1700), (150, 1800), (3000, 3100), (2000, 3500), (2500, 6000), (0, 3500)]]
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = [len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    told = nearcopies.least_apart([nearcopies.sketch(x) for x in sets], a, b)
    assert (told <= apart).all() and (told >= 0).all()
    far = [k for k, d in enumerate(apart) if d == len(sets[a[k]]) + len(sets[b[k]]) > 150 and 0.8 * len(sets[a[k]]) <= len(sets[b[k]]) <= 1.25 * len(sets[a[k]])]
    assert far and all(told[k] > apart[k] / 9 for k in far)


def test_texts_of_one_passage_are_no_candidates(spark):
    """Rows that leave a task over the prefixes: links, not the pairs of all texts with a passage in common."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 62, 30)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 62, 300)])) for _ in range(60)]
    sets.append(sets[0][:-5])
    rows = [(k, len(x), nearcopies.prefix(x, np.zeros(0, np.int64), 0.8).tolist(), nearcopies.sketch(x.view(np.uint64))) for k, x in enumerate(sets)]
    texts = spark.createDataFrame(rows, "id long, size long, prefix array<long>, sketch binary")
    none = spark.createDataFrame([], "node long, component long")
    links = nearcopies.prefix_links(nearcopies.shared_prefixes(texts.drop("sketch")), none, texts.select("id", "sketch"), 0.8, 16)
    assert [tuple(r) for r in links.collect()] == [(0, 60)]


def test_near_copies_miss_no_short_pair(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(600):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 9, 10, 12, 16, 40]))]
        longer = [*text, f"w{rng.randrange(10**6)}"]
        a, b = (set(nearcopies.shingle_hashes(" ".join(t), 5).tolist()) for t in (text, longer))
        want.append(2 * k if len(a & b) / len(a | b) >= 0.8 else 2 * k + 1)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(longer))]
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] for k in range(600)] == want and all(got[2 * k] == 2 * k for k in range(600))


def test_thresholds_reach_the_recall():
    costs = [[(-1, 0.0, 1.0), (0, 1.0 + k, 0.9), (1, 3.0 + k, 0.6)] for k in range(12)]
    cost, chosen = nearcopies.allocate(costs, 0.05)
    missed = math.prod({-1: 1.0, 0: 0.9, 1: 0.6}[t] for t in chosen)
    assert missed <= 0.05 and cost == sum({-1: 0, 0: 1 + k, 1: 3 + k}[t] for k, t in enumerate(chosen))
    assert nearcopies.allocate(costs[:1], 0.05) is None


def test_spanning_forest_is_least():
    rng = np.random.default_rng(2)
    u, v, d = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 50, 200)
    u, v, d = u[u != v], v[u != v], d[u != v]
    kept = nearcopies.spanning_forest(u, v, d, 30)
    parent, least = list(range(30)), 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in np.argsort(d, kind="stable"):
        if root(u[k]) != root(v[k]):
            parent[root(u[k])] = root(v[k])
            least += d[k]
    assert d[kept].sum() == least and len(kept) == 30 - len({root(x) for x in range(30)})


def test_simhash_links_are_exact(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 2, 4, 5, 7)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted(r)) for r in simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want


def test_embeddings_brute_and_odd(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(k, [float(x) for x in base[k % 40] + 0.1 * rng.standard_normal(16)], k % 2) for k in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0], 0), (404, rows[0][1], 0), (405, rows[0][1], None), (406, [None, 1.0], 1)]
    got = {r["vec_id"]: r for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=32).collect()}
    assert len(got) == len(rows)
    f = {k: np.array(v, np.float32).astype(float) for k, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    f = {k: v / np.linalg.norm(v) for k, v in f.items()}
    lab = {k: label for k, _, label in rows}
    links = {k: [j for j in f if j != k and lab[j] is not None and lab[j] == lab[k] and len(f[j]) == len(f[k]) and f[j] @ f[k] >= 0.93] for k in f}
    assert sum(got[k]["n_links"] for k in links) >= 0.97 * sum(map(len, links.values()))
    assert all(got[k]["n_links"] <= len(links[k]) for k in links)
    assert got[404]["component_id"] == got[0]["component_id"] and not got[404]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (400, 401, 402, 405, 406))
    assert embeddings.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_mixing_meets_targets(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    taken = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in sorted(got, key=lambda r: r["copies"])}
    named = odd.withColumns({c: F.lit("mine") for c in ("_id", "_source", "_words", "_copies", "_size", "_key", "_copy")})
    out = mixing.mixed_documents(named)
    rows = out.collect()
    assert out.columns == named.columns and all(r["_id"] == r["_size"] == r["_copies"] == r["_key"] == "mine" for r in rows)
    assert len(rows) == sum(taken[r["doc_id"], r["source"], len((r["text"] or "").split())] for r in odd.collect())


def test_mixing_balances_entropy(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "w " * int(rng.lognormvariate(3, 1)), f"s{min(i % 7, 2)}" if i % 50 else None) for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).toPandas()
    by = rows.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), rates=("rate", "nunique"))
    assert (abs(by["taken"] - by["target"]) <= 3).all()
    assert by["target"].sum() == pytest.approx(by["size"].sum())
    assert by["rates"].max() > 10 and (abs(rows["copies"] - rows["rate"]) < 1).all() and rows["copies"].max() <= 3
    # The multipliers are those of entropy balancing: within a source log rates follow the two moments of log size, and all words keep their log length.
    wanted = rows["target"] / rows["source_size"]
    words, length = rows["size"].to_numpy(float), np.log1p(rows["size"].to_numpy(float))
    mean = (words * length).sum() / words.sum()
    assert (words * rows["rate"] * length).sum() / (words * rows["rate"]).sum() == pytest.approx(mean, rel=5e-3)
    inner = (rows["rate"] < 3) & (rows["size"] > 0)
    for source in ("s0", "s1"):
        mine = (rows["source"] == source) & inner
        fit = np.polyfit(length[mine], np.log(rows["rate"][mine]), 2)
        assert np.abs(np.polyval(fit, length[mine]) - np.log(rows["rate"][mine])).max() < 1e-6
    assert (words * (rows["rate"] - wanted))[rows["source"] == "s1"].sum() == pytest.approx(0, abs=0.01)


def test_mixing_leaves_texts_where_they_are(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, "w " * int(rng.lognormvariate(3, 1)), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "24k")  # a table with a row for each document is over it
    try:
        out = mixing.mixed_documents(docs)
        rows = out.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("n"), (F.col("text") == "").alias("none")).collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and not any(x in plan for x in ("SortMergeJoin", "ShuffledHashJoin", "hashpartitioning"))
    every = docs.select(F.sum(mixing.words(F.col("text")))).first()[0]
    for k in range(3):
        assert abs(sum(r["n"] for r in rows if r["source"] == f"s{k}" and not r["none"]) - every * (k + 1) / 6) <= 3
    assert max(sum(1 for r in rows if r["doc_id"] == i) for i in range(0, 6000, 97)) <= 3


def test_mixing_targets_are_the_shared_ones(spark, tmp_path):
    import duckdb

    sizes = {"a": 5, "b": 400, "c": 3, None: 60, "d": 9, "é": 1, "Z": 0, "e": 30}
    docs = [(k, "w " * n, source) for k, (source, n) in enumerate(sizes.items())] + [(None, None, "d")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixing(spark, str(tmp_path)).toPandas()
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights, full = {s: 1 + k % 3 for k, s in enumerate(names)}, set()
    while True:  # shares again until none is above its cap
        rest = [s for s in names if s not in full]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in rest) if rest else 0
        over = {s for s in rest if weights[s] * level >= 3 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 3 * sizes[s] if s in full else weights[s] * level for s in names}
    assert {None if r["source"] is None else r["source"]: r["target"] for _, r in got.iterrows()} == pytest.approx(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(f"SELECT doc_id, size, source_size, target, source FROM ({mixing.OP3_SQL})").df()
    order = ["source", "size", "target"]
    assert got[["size", "source_size", "target", "source"]].sort_values(order).to_numpy().tolist() == told[["size", "source_size", "target", "source"]].sort_values(order).to_numpy().tolist()


def test_pieces_round_trip_and_probabilities(spark, odd):
    docs = pieces.encode_texts(odd)
    got = pieces.decode_ids(docs).select("text", "decoded", "samples", "ids").collect()
    assert len(got) == odd.count() and all(r["text"] == r["decoded"] for r in got)
    vocabulary = pieces._loaded(pieces.load())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in got:
        if r["text"]:
            assert library.decode(list(r["ids"])) == r["text"]
            assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"])
            assert all(pieces.decode(s["ids"], vocabulary) == r["text"] for s in r["samples"])
    checked = pieces.encode_texts(odd.withColumn("_key", F.lit("mine")), check=True).collect()
    assert all(r["round_trip"] is (None if r["text"] is None else True) and r["_key"] == "mine" for r in checked)
    assert pieces.decode_ids(docs.select("ids")).count() == odd.count()


def test_pieces_of_many_marks_and_little_mass():
    vocabulary = pieces._loaded(pieces.load())
    wide = max(len(t) for t in vocabulary.texts if t and not t.strip(pieces.MARK))
    assert wide > 8
    text = "a" + " " * (wide + 2) + "b\n  c "
    ((ids, drawn),) = pieces.segment([text], np.array([3]), vocabulary, 3)
    assert max(len(vocabulary.texts[i]) for i in ids if not vocabulary.texts[i].strip(pieces.MARK)) > 8
    assert all(pieces.decode(i, vocabulary) == text for i in (ids, *(d[0] for d in drawn))) and len(drawn) == 3
    # A piece of nearly all the mass leaves ways of under 1e-15 of it: they are sampled all the same.
    small = pieces.Vocabulary(("ab", *("",) * 300, "a", "b"), 10)
    weights = np.zeros(304)
    weights[[0, 301, 302]] = 1.0, 1e-12, 1e-12
    small.__dict__["weights"] = weights
    ((_, drawn),) = pieces.segment(["ab"], np.array([1]), small, 3)
    assert len(drawn) == 2 and drawn[1][1] == pytest.approx(math.log(1e-24))


def test_pieces_sample_without_replacement():
    vocabulary, n = pieces._loaded(pieces.load()), 4000
    drawn = [s for _, s in pieces.segment(["then"] * n, np.arange(n), vocabulary, 3)]
    p = {tuple(i): math.exp(lp) for s in drawn for i, lp, _ in s}
    assert sum(p.values()) == pytest.approx(1, abs=1e-4)
    first = sum(max(p, key=p.get) == tuple(s[0][0]) for s in drawn) / n
    assert first == pytest.approx(max(p.values()), abs=0.01)
    assert np.mean([sum(math.exp(lp) / q for _, lp, q in s) for s in drawn]) == pytest.approx(1, abs=0.02)
    again = pieces.segment(["then"] * 3, np.array([5, 6, 7]), vocabulary, 3)
    assert [[list(i) for i, _, _ in s] for _, s in again] == [[list(i) for i, _, _ in s] for s in drawn[5:8]]


def test_likeliest_is_the_best_of_all():
    vocabulary = pieces._loaded(pieces.load())
    known = {t: k for k, t in enumerate(vocabulary.texts) if t}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest in ways(s[k:]):
                    yield (known[s[:k]], *rest)

    for word in ("then", "house", "a"):
        weight = lambda w: sum(2.2 * len(vocabulary.texts[i]) - math.log(i + 10) for i in w)
        every = list(ways(pieces.MARK + word))
        (best, drawn), = pieces.segment([word], np.array([1]), vocabulary, 2)
        assert weight(best) == pytest.approx(max(map(weight, every)))
        total = math.log(sum(math.exp(weight(w)) for w in every))
        assert all(lp == pytest.approx(weight(i) - total) for i, lp, _ in drawn)


def test_likeliest_of_long_runs():
    vocabulary = pieces._loaded(pieces.load())
    known = {t: k for k, t in enumerate(vocabulary.texts) if t}

    def weighed(ids):
        return sum(-math.log(32010) if vocabulary.byte_id <= i < vocabulary.byte_id + 256 else 2.2 * len(vocabulary.texts[i]) - math.log(i + 10) for i in ids)

    rng = random.Random(4)
    texts = ["thenhouse" * 30, "a" + " " * 60 + "b", "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789+/", k=3000)), "https://example.org/some/long/path?with=parameters&and=more\nnext" * 3, "".join(rng.choices("\U00012345\U0001f9ff", k=100)) + "end"]
    for text, (best, drawn) in zip(texts, pieces.segment(texts, np.arange(len(texts)), vocabulary, 2), strict=True):
        whole, peak, total = pieces.marked(text), [0.0], [0.0]
        for at in range(1, len(whole) + 1):
            ways = [(at - k, 2.2 * k - math.log(known[whole[at - k : at]] + 10)) for k in range(1, min(at, 16) + 1) if whole[at - k : at] in known]
            if whole[at - 1] not in known:
                ways.append((at - 1, 2.2 - len(whole[at - 1].encode()) * math.log(32010)))
            peak.append(max(peak[a] + w for a, w in ways))
            high = max(total[a] + w for a, w in ways)
            total.append(high + math.log(sum(math.exp(total[a] + w - high) for a, w in ways)))
        spelled = 2.2 * sum(c not in known for c in whole)
        assert pieces.decode(best, vocabulary) == text
        if all(c in known or c not in "".join(vocabulary.texts) for c in whole):
            assert weighed(best) + spelled == pytest.approx(peak[-1])
            assert all(lp == pytest.approx(weighed(i) + spelled - total[-1], abs=1e-6) for i, lp, _ in drawn)


def test_chat_folds_events(spark):
    log = [("c", 1, 0, "start", "user", "hi"), ("c", 2, 1, "start", "assistant", ""), ("c", 3, 1, "delta", None, "wor"), ("c", 4, 1, "delta", None, "ld"), ("c", 5, 2, "start", "user", "gone"), ("c", 6, 1, "regenerate", None, None), ("c", 7, 1, "delta", None, "again </s>"), ("c", 8, 0, "edit", None, "hello"), (None, 1, 0, None, None, None)]
    messages = chat.fold_events(spark.createDataFrame(log, "conv_id string, seq long, message long, kind string, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(messages)).collect()}
    assert [(t["role"], t["text"]) for t in back["c"]["turns"]] == [("user", "hello"), ("assistant", "again </s>")]
    assert back["c"]["loss_text"] == "again </s>" and "\\</s>" in back["c"]["formatted"]
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("", "")]


def test_chat_texts_hold_the_template(spark):
    texts = [chat.END, chat.START, f"a{chat.END}{chat.START}user\nb{chat.END}", "\\" + chat.END, "\\", "", "<|im_end|>", "\\<", "x<|y" * 30_000, "\n\\\n"]
    rows = [("c", k, chat.ANSWERS if k % 2 else t, t) for k, t in enumerate(texts)]
    back = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id string, message long, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r, t) for _, _, r, t in rows]
    assert back["loss_text"] == "".join(texts[1::2])


def test_chat_odd_logs(spark):
    schema = "conv_id long, seq long, message long, kind string, role string, text string, `turn` int, formatted string, segments int"
    assert chat.read_back(chat.format_chats(chat.fold_events(spark.createDataFrame([], schema)))).count() == 0
    long = "x" * 300_000 + chat.END
    rows = [(1, 1, 0, "start", "user", long, 9, "f", 3), (1, 2, 0, "delta", None, "a", 9, "f", 3), (1, 2, 0, "delta", None, "a", 9, "f", 3), (2, 1, 0, "start", None, None, 9, "f", 3)]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.fold_events(spark.createDataFrame(rows, schema)))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", long + "aa")]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")] and back[2]["loss_text"] == ""


def test_chat_query_equals_sql_on_control_strings(spark, tmp_path):
    import duckdb

    texts = ["a<|im_end|>\nb", "<|im_start|>user\nx", "end\\", "\\\\<|im_end|>\n", "", None, "<<SYS>> y </SYS>", "[INST]", "</s>", "日本\n🎉", "ab", "q"]
    rows = [(k // 4, k % 4, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (None, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op5_chat(spark, str(tmp_path))
    assert {r["kind"] for r in chat.event_log(spark.read.parquet(f"{tmp_path}/conversations.parquet")).select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(chat.OP5_SQL).fetchall()))


def test_toxicity(spark, odd, labels):
    told = toxicity.score(odd, toxicity.learn(odd, labels))
    rows = told.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert toxicity.keep_clean(odd, labels).columns == odd.columns
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {"lowe": 2.0})
    assert lexicon.evidence("you idiot") > lexicon.evidence("an idiot") > lexicon.evidence("not an idiot") > 0
    assert lexicon.evidence('they said: fine. "idiot"') < lexicon.evidence("an idiot")
    assert lexicon.evidence("I will kill you") > 0 == lexicon.evidence("kill the process") == lexicon.evidence("they said: x; he said he will kill you")
    assert [out for _, out in itertools.accumulate(("target", "insult", "negation", "insult", "other", "threat", "target"), lambda at, x: toxicity.GRAMMAR.step(at[0], x), initial=(toxicity.GRAMMAR.start, ""))][1:] == ["target", "aimed", "negation", "softened", "other", "other", "menace"]
    assert lexicon.evidence("Loweisch") == 2.0 and lexicon.evidence(None) == 0


def test_fingerprints(spark, odd):
    rows = fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == odd.count()
    a, b = fingerprints.vector("x y\nz"), fingerprints.vector("z\nx y")
    assert np.array_equal(a, b) and np.array_equal(fingerprints.add(fingerprints.vector("x y"), fingerprints.vector("z")), a)
    assert np.array_equal(fingerprints.remove(a, fingerprints.vector("z")), fingerprints.vector("x y"))
    ordered = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in ODD), key=lambda x: x[0])
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (4, None)}
    for k, (doc_id, text) in enumerate(ordered):
        if rows and doc_id in by:
            cut = len(text) // 4
            edited = text[: len(text) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]
            assert by[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_sharding(spark, odd):
    rows = sharding.shard(odd, shards=3).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(3)]
    assert len(rows) == odd.count() and max(counts) - min(counts) <= 1
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for n in (1, 2, 5, 1000):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p) == list(range(n)) and (sharding.unpermute(p, n) == np.arange(n)).all()


def test_quality(spark, odd, labels):
    rows = quality.score(odd, quality.learn(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.5, rng.standard_normal(quality.BUCKETS + quality.STATS + 1), rng.standard_normal((quality.BUCKETS + quality.STATS + 1, 4)) / 9, np.zeros(quality.STATS), np.ones(quality.STATS))
    b, v, s = quality.features("some words of some text", None)
    at, x = np.concatenate([b, np.arange(quality.BUCKETS, quality.BUCKETS + quality.STATS + 1)]), np.concatenate([v, machine.scaled(s), [1.0]])
    y = machine.weights[at] @ x + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.score("some words of some text", None) == pytest.approx(1 / (1 + math.exp(-y)))


def test_language(spark, odd):
    profiles = langid.learn_profiles(odd)
    rows = langid.identify(odd, profiles).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    if rows:
        assert (by[2]["lang_pred"], by[3]["lang_pred"]) == ("und", "und") and by[1]["lang_pred"] == "en"
    assert langid.keep_known(odd).columns == odd.columns
    codes, counts = langid.ngrams("Ab ab1")
    want = {}
    for g in ("a", "b", "a", "b", " a", "ab", "b ", " a", "ab", "b ", " ab", "ab ", " ab", "ab "):
        want[g] = want.get(g, 0) + 1
    name = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    assert {name(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == want


def test_toxicity_learns_the_weights_of_outputs():
    rng = np.random.default_rng(4)
    sums, label = rng.exponential(2.0, (4000, 4)) * (rng.random((4000, 4)) < 0.4), np.zeros(4000)
    label[:] = rng.random(4000) < 1 / (1 + np.exp(-(-6 + 3 * np.log1p(sums @ [1, 4, 0.2, 3]))))
    outputs, (_, slope, _) = toxicity.fit_curve(sums, np.full(4000, 50.0), label)
    assert outputs[1] > 1.8 and outputs[2] < 0.45 and outputs[0] == 1 and slope > 1.5
    none = np.zeros((10, 4))
    assert toxicity.fit_curve(none, np.ones(10), np.arange(10) % 2)[0] == pytest.approx(toxicity.PRIOR)


def _held_out(spark, query, column):
    from tidemark.llm.queries import QUERIES

    data = "/root/testdata/sf0.1"
    rows = QUERIES[query](spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where(F.col(column).isNotNull())
    counts = {(r[column], r["predicted"]): r["count"] for r in rows.groupBy(column, "predicted").count().collect()}
    return counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)


def test_held_out_toxicity(spark):
    hit, missed, false = _held_out(spark, "op6_toxicity", "toxic")
    # Nine of the 144 toxic texts have none of the words that the others have.
    assert hit / (hit + missed) >= 0.93 and hit / (hit + false) >= 0.95


def test_held_out_quality(spark):
    hit, missed, false = _held_out(spark, "op9_quality", "quality")
    assert hit / (hit + missed) >= 0.99 and hit / (hit + false) >= 0.99


def test_first_step_of_the_trie_is_looked_up_and_bytes_are_put_in_place():
    vocabulary = pieces._loaded(pieces.load())
    classes = np.arange(int(vocabulary.trie[0].max()) + 1)
    assert (vocabulary.begun == vocabulary.follow(np.zeros(len(classes), np.int32), classes)).all()
    texts = ["", "a▁b \U0001f9ff\U0001f9ff", "\x01\x02 z", "   ", "plain words"]
    for text, (ids, drawn) in zip(texts, pieces.segment(texts, np.arange(5), vocabulary), strict=True):
        assert [pieces.decode(x, vocabulary) for x in (ids, *(d[0] for d in drawn))] == [text] * (1 + len(drawn))


def test_pieces_make_common_words_once(monkeypatch):
    vocabulary, rng = pieces._loaded(pieces.load()), random.Random(9)
    common = ["the", "Übermaß", "thing.\nthat", "日本", "x" * 60]
    texts = [" ".join([*rng.choices(common, k=30), f"lone{k}", "🎉"]) for k in range(40)]
    keys, ends, built = np.arange(40), [10, 20, 30, 40], []
    apart = [d for a, b in zip([0, *ends], ends) for d in pieces.segment(texts[a:b], keys[a:b], vocabulary)]
    make = pieces.Lattice.__init__
    monkeypatch.setattr(pieces.Lattice, "__init__", lambda self, written, sizes, v: (built.append(len(written)), make(self, written, sizes, v))[1])
    together = list(pieces.segment_blocks(pieces.pa.array(texts), keys, ends, vocabulary, 3))
    assert sum(built) < sum(map(len, common)) + 40 * 8 + 20
    for k, (ids, drawn) in enumerate(apart):
        found, at = together[k // 10], k % 10
        assert found.ids[found.first[at] : found.first[at + 1]].tolist() == ids.tolist()
        for (i, first, logp, inside, has), (want, p, q) in zip(found.samples, drawn, strict=True):
            assert has[at] and i[first[at] : first[at + 1]].tolist() == want.tolist() and (logp[at], inside[at]) == pytest.approx((p, q))
