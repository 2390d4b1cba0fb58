"""Importance resampling, quality rules and the Merkle manifest against brute force, also on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tests.llm.test_operators import DATA, EXTRA, ODD, SCHEMA
from tidemark.llm import importance, merkle, rules, words
from tidemark.llm.queries import QUERIES, SQL


@pytest.fixture(params=["plain", "clash", "empty"])
def odd(spark, request):
    if request.param == "plain":
        return spark.createDataFrame(ODD, SCHEMA)
    if request.param == "empty":
        return spark.createDataFrame([], SCHEMA)
    more = EXTRA + ", leaf string, `key` int, part int, place int, n int, grp int, tie int, fit int, weight int, rank int, n_words int, kept int"
    return spark.createDataFrame([(*r, 1.0, 1, 1, [1], 5, 6, 7, "x", *range(11)) for r in ODD], SCHEMA + more)


@pytest.mark.parametrize("name", ["op11_importance", "op13_merkle"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(ws, n):
    return [" ".join(ws[i : i + m]) for m in range(1, n + 1) for i in range(len(ws) - m + 1)]


def plain_resample(docs, target, n, buckets, percent, least, seed):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    features = [grams(plain_words(t), n) for _, t in docs]
    s, t = Counter(bucket(g) for f in features for g in f), Counter(bucket(g) for x in target for g in grams(plain_words(x), n))
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in range(buckets)}
    rows = []
    for (doc_id, text), f in zip(docs, features, strict=True):
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_importance_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "three four FIVE"), (2, None), (3, "日本 é x2")], "item_id long, text string")
    got = Counter(map(tuple, importance.resample(odd, target, 3, 50, 60, 2, 9).collect()))
    assert got == (plain_resample([(r["doc_id"], r["text"]) for r in odd.collect()], ["three four FIVE", None, "日本 é x2"], 3, 50, 60, 2, 9))
    empty = importance.resample(odd, target.limit(0), 2).collect()
    assert len(empty) == odd.count() and all(r["weight"] <= 0 for r in empty)


def test_suffix_runs_are_the_repeats():
    rng = np.random.default_rng(3)
    for size, n in ((0, 2), (1, 2), (50, 1), (400, 3), (900, 5)):
        ids = rng.integers(0, 4, size)
        for m, (suffixes, run, first) in enumerate(importance.suffix_runs(ids, n), 1):
            assert sorted(suffixes.tolist()) == list(range(size))
            by_run = {}
            for at, r in zip(suffixes.tolist(), run.tolist(), strict=True):
                gram = tuple(ids[at : at + m].tolist())
                if len(gram) == m and 0 not in gram:
                    by_run.setdefault(gram, set()).add(r)
            assert all(len(r) == 1 for r in by_run.values()), "equal m-grams lie in one run"
            assert len({next(iter(r)) for r in by_run.values()}) == len(by_run), "a run holds one m-gram"
            assert len(first) == (run[-1] + 1 if size else 0)


def test_long_texts_in_pieces_count_the_same():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd éf g1 --".split()) for _ in range(rng.choice([0, 1, 3, 700]))).encode() for _ in range(30)]
    for n in (1, 2, 4):
        want = [Counter(grams(plain_words(t.decode()), n)) for t in texts]
        for segment, chunk in ((10, 7), (200, 1), (10**6, 10**6)):
            got = [Counter() for _ in texts]
            for ids, owners, vocabulary in importance.segments(iter(texts), n, segment, chunk):
                for m, (crc, there) in enumerate(importance.gram_hashes(ids, vocabulary, n), 1):
                    for at in np.flatnonzero(there & (owners >= 0)):
                        gram = b" ".join(vocabulary[k] for k in ids[at : at + m])
                        assert zlib.crc32(gram) == crc[at]
                        got[owners[at]][gram.decode()] += 1
            assert got == want


def test_chunks_cut_between_words():
    raw = ("aé b  cc\tdddd" * 300 + "z" * 9000 + " y").encode()
    for size in (1, 5, 64, 10**6):
        assert [w for c in words.chunks(raw, words.SPACED, size) for w in c] == raw.split()


def plain_metrics(text):
    text = text or ""
    ws, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in worded:
        dup += x in seen
        seen.add(x)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(worded)


def test_quality_metrics(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n\v\f ", "a", "a b c d e a b c d e", "a a a a a a", "x\nx\n\n x\nx", "é# $ 日本|<\n" * 3, "w " * 70_000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d", "&", "\t", "ü "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    want = [plain_metrics(t) for t in texts]
    for segment in (1, 40, 1 << 19):
        monkeypatch.setattr(rules, "SEGMENT", segment)
        assert list(map(tuple, rules.measure([(t or "").encode() for t in texts]))) == want
    docs = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for k, m in enumerate(want):
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        assert tuple(got[k][c] for c in rules.METRICS) == m and got[k]["base_failed"] == failed and got[k]["kept"] == (not failed)


def binomial_at_most(k, n, p):
    p = Fraction(p)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_cutoffs_are_certified_exactly():
    rng, risk, error = np.random.default_rng(4), 0.04, 0.01
    for _ in range(60):
        n = int(rng.integers(0, 400))
        good, bad = np.bincount(np.minimum(rng.geometric(0.2, n), 63), minlength=64), np.bincount(rng.integers(0, 64, 50), minlength=64)
        best, want = 0.0, None
        for cut in range(63, 0, -1):
            k = int(good[cut:].sum())
            if not n or binomial_at_most(k, n, risk) > error:
                break
            if (gain := bad[cut:].sum() / 50 - rules.WORTH * k / n) > best:
                best, want = gain, cut
        assert rules.certified(good, bad, risk, error) == want
    assert rules.certified(np.zeros(64, int), np.ones(64, int), risk, error) is None


def test_strata_have_cutoffs_of_their_own_and_keep_good_documents(spark):
    """In a: junk is marked by symbols. In b those marks are common among good texts, in c nothing is labelled."""
    rng = random.Random(8)

    def text(marks):
        return " ".join(f"word{rng.randrange(5000)}" + ("#$" if rng.random() < marks else "") for _ in range(40))

    rows, labels = [], []
    for lang in ("a", "b", "c", None):
        for good in (1, 0):
            for _ in range(900 if good else 150):
                rows.append((len(rows), lang, text(0.8 if not good or lang == "b" and rng.random() < 0.5 else 0.0)))
                labels += [(rows[-1][0], good)] * 2 if lang in ("a", "b") else []
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")).collect()
    kept, good = {r["doc_id"]: r["kept"] for r in got}, dict(labels)
    assert not any(kept[k] for k, lang, _ in rows if lang == "a" and not good[k]), "junk goes"
    for lang in ("a", "b"):
        of = [kept[k] for k, x, _ in rows if x == lang and good[k]]
        assert of.count(False) <= rules.RISK * len(of)
    assert all(kept[k] for k, lang, _ in rows if lang in ("c", None)), "nothing is rejected without proof"


def test_rules_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    got = rules.judge(odd, labels).collect()
    assert Counter((r["doc_id"], tuple(r[c] for c in rules.METRICS)) for r in got) == Counter((r["doc_id"], plain_metrics(r["text"])) for r in odd.collect())


def sha(x):
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) in, results as a multiset out."""

    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(value, (*r[:4], text))))

    def rise(level):
        """Levels of a tree, from its leaves."""
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def walk(levels, at, fold, proof):
        for level in levels[:-1]:
            run = level[at - at % 16 : at - at % 16 + 16]
            k = at % 16
            proof += "".join(run[:k] + run[k + 1 :])
            fold, at = sha("".join([*run[:k], fold, *run[k + 1 :]])), at // 16
        return fold, proof

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4]), r) for r in by[s]), key=lambda x: x[:3]) for s in sources}
    trees = {s: rise([x[2] for x in leaves[s]]) for s in sources}
    top, out = rise([trees[s][-1][0] for s in sources]) if sources else None, Counter()
    for number, s in enumerate(sources):
        for at, (_, _, digest, r) in enumerate(leaves[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold, proof = walk(trees[s], at, leaf(r, text), "")
            fold, proof = walk(top, number, fold, proof)
            out[r[0], digest, trees[s][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]] += 1
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest_odd_rows(spark, odd):
    assert Counter(map(tuple, merkle.manifest(odd).collect())) == plain_manifest([tuple(r[c] for c in FIELDS) for r in odd.collect()])


def test_manifest_of_many_sources_and_a_hot_one(spark):
    rng = random.Random(6)
    rows = [(k if k % 50 else None, "hot" if k % 3 else f"s{rng.randrange(40)}", "en", k, f"Text {k % 400} É") for k in range(2500)]
    rows += [(9000, "lone", None, None, None), (9001, None, "en", 1, "A"), (9001, None, "en", 1, "A")] + [(10_000 + k, "exact", "x", 1, "Q") for k in range(256)] + [(11_000 + k, "over", "x", 1, "Q") for k in range(257)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    want = plain_manifest(rows)
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == want
    assert sum(c for r, c in want.items() if not r[-1]) > 300, "tampering is found"


def test_tree_does_not_depend_on_how_rows_lie(spark):
    """Leaves in any order, one partition or many: the frontier's rounds end at the same root."""
    leaves = [(g, k, n, hashlib.sha256(f"{g}/{k}".encode()).digest()) for g, n in ((0, 1), (1, 16), (2, 17), (3, 5000)) for k in range(n)]
    roots = []
    for parts in (1, 9):
        random.Random(parts).shuffle(leaves)
        nodes = merkle.tree(spark.createDataFrame(leaves, "grp long, place long, n long, digest binary").repartition(parts)).collect()
        assert len(nodes) == 1 + 1 + 3 + 313 + 20 + 2 + 1
        roots.append({(r["grp"], r["level"], r["place"]): bytes(r["digest"]) for r in nodes})
    assert roots[0] == roots[1]


def test_embeddings_query_equals_its_sql_on_planted_links(spark, tmp_path):
    """Chains, copies, other labels, zero and null vectors: the table's own rows have hardly a link."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        base = rng.normal(size=32)
        rows.append((len(rows), base.tolist(), k % 3))
        for _ in range(k % 5):
            base = base + rng.normal(scale=0.25, size=32)
            rows.append((len(rows), base.tolist(), k % 3 if k % 7 else None))
        if k % 6 == 0:
            rows.append((len(rows), rows[-1][1], (k + 1) % 3))
            rows.append((len(rows), rows[-1][1], (k + 1) % 3))
    rows += [(len(rows), [0.0] * 32, 1), (len(rows) + 1, None, 1), (len(rows) + 2, [0.0] * 32, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(SQL["op2_embeddings"])
    got = QUERIES["op2_embeddings"](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    assert sum(r["n_links"] for r in got) > 100 and sum(not r["kept"] for r in got) > 50


def test_held_out_languages(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in QUERIES["op10_langid"](spark, DATA).collect() if r["held_out"] and docs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(held) > 30 and sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_sharding_is_a_plain_feistel_walk():
    from tidemark.llm import sharding

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    for n in (1, 2, 5, 64, 1000):
        half = next(h for h in range(1, 40) if 4**h >= n)
        keys = [mix((k * 0x9E3779B97F4A7C15 + sharding.KEY) % 2**64) for k in range(1, sharding.ROUNDS + 1)]
        got = sharding.permute(np.arange(n), n)
        for start in range(n):
            at = start
            while True:
                left, right = at >> half, at % 2**half
                for key in keys:
                    left, right = right, left ^ mix((right + key) % 2**64) % 2**half
                at = left << half | right
                if at < n:
                    break
            assert got[start] == at
