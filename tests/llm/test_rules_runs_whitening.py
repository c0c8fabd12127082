"""Quality rules, periodic runs and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cuemill.llm import periodic, quality_rules, queries, whitening
from cuemill.llm._words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\n", "one", "One two", "a b c d e", "a b c d e", "éé 世界 \x00 x # <>", "word " * 3000, "x" * 50000, "l m\nl m\n\n \nl m n\nl m"]


# 11 quality rules


def hashed(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w if isinstance(w, bytes) else w.to_bytes(8, "little"), seed)
    return seed


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def buckets(text):
    h = [hashed(w.encode()) for w in WORD.findall(text or "")]
    return [x % quality_rules.BUCKETS for x in [*h, *map(hashed, h, h[1:])]]


def judged(rows):
    """rows: (key, text, trusted)."""
    counts = {s: np.zeros(quality_rules.BUCKETS) for s in (0, 1, 2)}
    side = lambda t, ok: 0 if not ok else 1 + ((hashed(t.encode()) - ((hashed(t.encode()) >> 63) << 64)) % 2 if t is not None else 42 % 2)
    for _, t, ok in rows:
        np.add.at(counts[side(t, ok)], buckets(t), 1)
    raw, target = sum(counts.values()), counts[1] + counts[2]
    ratio = lambda c: np.log((c + 1) / (c.sum() + quality_rules.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality_rules.BUCKETS))
    mean = lambda t, r: float(np.mean(r[buckets(t)])) if buckets(t) else 0.0
    own = sorted(math.floor(mean(t, ratio(counts[3 - side(t, ok)])) / quality_rules.STEP) for _, t, ok in rows if ok and buckets(t))
    threshold = own[math.floor(quality_rules.TAIL * len(own))] * quality_rules.STEP if own else None
    out = {}
    for key, t, _ in rows:
        n, *_, again = b = base(t)
        failed = n < 10 or 100 * again > 20 * n
        out[key] = (*b, failed, not failed and (threshold is None or mean(t, ratio(target)) >= threshold))
    return out


def test_quality_rules_are_those_of_brute_force(spark):
    rng = random.Random(5)
    fine, junk = [f"word{i}" for i in range(40)], [f"j{i}###" for i in range(40)]
    texts = [" ".join(rng.choice(fine if i % 4 else junk) for _ in range(rng.randrange(1, 60))) for i in range(120)]
    texts += ["a b c d e f g h i j k l. " * 3, "p q r s t u v w x y z p q r s t a b c d e f g h i j k l m n o", *ODD]
    rows = [(i, t, i % 4 != 0 and i % 3 != 0 and i < 120) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _trusted boolean").withColumn("n_words", F.lit("clash")).withColumn("score", F.lit(1))
    model = quality_rules.fit(df, F.col("_trusted"))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(df, model, keep=["doc_id"]).collect()}
    want = judged(rows)
    assert got == want
    assert sum(want[i][-1] for i in range(120) if i % 4 == 0) == 0 and sum(want[i][-1] for i in range(120) if i % 4) > 60


def test_quality_rules_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f g h i j k"), (1, None), (1, None)], "doc_id long, text string")
    model = quality_rules.fit(df, F.lit(None).cast("boolean"))
    assert model.ratios is None
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality_rules.judge(df, model, keep=["doc_id"]).collect()) == [(0, True), (1, False), (1, False)]
    assert quality_rules.judge(df.where("false"), quality_rules.fit(df.where("false"), F.lit(True)), keep=["doc_id"]).collect() == []
    # a trusted text without words gives no threshold of its own
    assert quality_rules.judge(df, quality_rules.fit(df, F.col("text").isNull()), keep=["doc_id"]).count() == 3


def test_quality_rules_keep_clean_documents(spark, sf_dir):
    out = queries.op11_quality_rules(spark, sf_dir)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = out.collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {i: base(t) for i, t in docs.items()}
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == (1, 0) and not r["base_failed"]]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"], (1, 0))[0] == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.2 * len(junk)


# 12 periodic runs


def brute_runs(w):
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i - a >= p and i - a + p >= 12:
                best.setdefault((a, i - a + p), p)
    return sorted((a, length, p) for (a, length), p in best.items())


def strange(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 150, 300])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if n > 20 and rng.random() < 0.3:
        w[rng.randrange(n)] = "other"
    if rng.random() < 0.15:  # Fibonacci and Thue-Morse words are full of runs, and of near misses
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        w = list(b[:n]) if rng.random() < 0.5 else [str(bin(i).count("1") % 2) for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    docs = [strange(rng) for _ in range(rng.choice([1, 1, 4, 12]))]
    runs, at = periodic.runs_of(split_words(pa.array([" ".join(d) for d in docs])))
    assert [[tuple(r) for r in runs[at[i] : at[i + 1]].tolist()] for i in range(len(docs))] == [brute_runs(d) for d in docs]


@pytest.mark.parametrize("step", [1, 2, 7, 64])
def test_runs_do_not_depend_on_how_words_arrive(step):
    rng = random.Random(step)
    for _ in range(6):
        words = strange(rng)
        hashes = split_words(pa.array([" ".join(words)])).hash
        found = periodic.Catchers(len(words) + 3)
        for i in range(0, len(hashes), step):
            found.append(hashes[i : i + step])
            upto = words[: i + step]
            assert [tuple(r) for r in found.runs().tolist()] == brute_runs(upto)


def test_levels_cover_every_period():
    for longest in (0, 11, 12, 13, 14, 27, 28, 29, 30, 500):
        periods = sorted(p for _, lo, hi in periodic.levels(longest) for p in range(lo, hi + 1))
        assert periods == list(range(1, longest // 2 + 1))


def test_runs_table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b " * 9 + "c"), (99, "a b " * 9 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = {r["doc_id"]: r for r in periodic.find(df, keep=["doc_id"]).collect()}
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 100 else [(0, 3000, 1)]
        dropped = {j for a, length, p in runs for j in range(a + p, a + length)}
        assert [tuple(x) for x in got[i]["runs"]] == runs and got[i]["n_words"] == len(words)
        assert got[i]["collapsed"] == " ".join(w for j, w in enumerate(words) if j not in dropped)
    assert periodic.find(df.where("false"), keep=["doc_id"]).collect() == []


def test_runs_query_is_that_of_brute_force(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert len(got) == len(docs)
    changed = 0
    for key, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(key).encode())
        g, n = h // 10, len(words)
        if n > 400:
            continue
        if h % 10 == 0 and n:
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        dropped = {j for a, length, p in runs for j in range(a + p, a + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        top = (*first, 1000 * first[1] // first[2]) if first else (None,) * 4
        assert got[key] == (len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in dropped))), key
    assert changed > 5


# 13 whitening


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("component", F.lit("clash"))


def whitened(rows):
    """n, deviations, whitened with the sign of the greatest entry of each axis, shares."""
    x = np.floor(1024 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    apart = (n * x - sums) / n
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    return n, ((n * x - sums) ** 2).sum(axis=1), apart @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / max(values.sum(), 1e-300)


def same_as_brute_force(out, keys, rows):
    n, deviation, white, share = whitened(rows)
    k = len(share)
    got = {(r["vec_id"], r["component"]): r for r in out if r["vec_id"] in set(keys)}
    assert len(got) == len(keys) * k
    if not k:
        return
    mine = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in keys])
    assert np.allclose(mine * np.sign((mine * white).sum(axis=0)), white, atol=1e-8)
    assert all(got[i, c]["deviation"] == d and got[i, c]["n"] == n for i, d in zip(keys, deviation.tolist()) for c in range(1, k + 1))
    assert np.allclose([got[keys[0], c]["explained"] for c in range(1, k + 1)], share, rtol=1e-9)
    assert all(r["identity_error"] < 1e-6 for r in got.values())


def test_whitening_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    long = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).tolist()
    short = (rng.normal(size=(40, 3)) * [0.1, 0.5, 1]).tolist() + [[0.5, 0.25, 0.125]] * 30
    flat = [[float(i), 2.0 * i, 5.0] for i in range(9)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0]]
    out = whitening.whiten(table(spark, [*long, *odd, *short]).repartition(7), keep=["vec_id"]).collect()
    same_as_brute_force(out, range(300), long)
    same_as_brute_force(out, range(305, 375), short)
    assert not {r["vec_id"] for r in out} & set(range(300, 305))
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "HELD", 1)
    monkeypatch.setattr(whitening, "BLOCK", 20)
    out = whitening.whiten(table(spark, [*long, *odd, *short]).repartition(7), keep=["vec_id"]).collect()
    same_as_brute_force(out, range(300), long)
    same_as_brute_force(out, range(305, 375), short)
    same_as_brute_force(whitening.whiten(table(spark, flat), keep=["vec_id"]).collect(), range(9), flat)


def test_whitening_of_odd_tables(spark):
    empty = whitening.whiten(table(spark, [None]), keep=["vec_id"])
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 5), keep=["vec_id"]).collect() == []  # no variance
    far = whitening.whiten(table(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 3.0]]), keep=["vec_id"]).collect()
    assert {r["deviation"] for r in far} == {None} or len(far) > 0


def test_rank_one_updates_keep_the_decomposition():
    rng = np.random.default_rng(0)
    for make in (lambda: rng.normal(size=(200, 16)), lambda: rng.integers(0, 2, (80, 6)).astype(float), lambda: np.eye(6)[rng.integers(0, 6, 60)] * 1000, lambda: np.outer(rng.integers(0, 5, 50), np.arange(8.0)), lambda: rng.normal(size=(20, 1))):
        x = make()
        one, parts, block = whitening.Spectrum(x.shape[1]), [whitening.Spectrum(x.shape[1]) for _ in range(3)], whitening.Spectrum(x.shape[1])
        for row in x:
            one.add(row[None])
        for part, rows in zip(parts, np.array_split(x, 3)):
            part.add(rows)
        parts[0].merge(parts[1])
        parts[0].merge(parts[2])
        block.add(x)
        apart = x - x.mean(axis=0)
        want = apart.T @ apart
        for s in (one, parts[0], block):
            assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0))
            assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
            assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() <= 1e-11 * max(1, np.abs(want).max())


@pytest.mark.parametrize("k", [2, 3, 6, 40])
def test_secular_roots_are_eigenvalues(k):
    rng = np.random.default_rng(k)
    for rho in (1e-6, 1.0, 1e6):
        poles, z = np.sort(rng.random(k)), rng.normal(size=k)
        z /= np.sqrt(z @ z)
        vectors, values = whitening.secular(poles, z, rho)
        assert np.allclose(values, np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(z, z)), rtol=0, atol=1e-13 * max(1, rho))
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
