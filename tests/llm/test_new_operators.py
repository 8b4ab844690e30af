"""Fingerprints, whitening and periodic runs against brute force; edge cases of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from phonrisk.llm import fingerprints, runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, b int, copy boolean, sketch string, n long, key long"


@pytest.fixture(scope="module")
def edge(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(4000)}" for _ in range(30_000))
    texts = [None, "", " \n\t", "one", "one two three four", "é日本語😀 x", long, long, "a b " * 40, "\x0bq\r\nq", "x y z " * 7 + "end", "a" * 9]
    rows = [(3 * i - 5, t, None, 1, True, "s", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "nobody's words are here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (4, "other text, used id", "en", 1, False, "", 1, 1)]
    rows += [((1 << 62) + i, f"large ids {i}", None, None, None, None, None, None) for i in range(3)]
    return spark.createDataFrame(rows, DOCS)


def brute_sketch(text):
    w = WORD.findall(text)
    grams = [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] * bool(w)
    hashes = {hashlib.md5(g.encode()).hexdigest()[:16] for g in grams}
    return sorted(h for h in hashes if h < "2") or sorted(hashes)[:1]


def brute_likeness(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(a == b)


def brute_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        a, b, c = map(brute_sketch, (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), brute_likeness(a, b), brute_likeness(a, c)))
    return out


def test_fingerprints(spark, edge):
    for table in (edge, edge.filter("doc_id is null"), edge.filter("doc_id = -5"), edge.limit(0)):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = [tuple(r) for r in fingerprints.compare(table).collect()]
        assert sorted(got, key=repr) == sorted(brute_fingerprints(rows), key=repr)


def test_sketches_merge_and_contain(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(20_000)]
    part, tiny = words[5000:6000], ["only", "few", "words"]
    rows = [(" ".join(words), " ".join(part)), (" ".join(tiny), " ".join(part)), (" ".join(tiny), ""), ("", "")]
    a, b = fingerprints.sketch("a"), fingerprints.sketch("b")
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = df.select("a", "b", fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("b"), F.col("a")).alias("c")).collect()
    assert got[0].c == 1.0 and 90 < len(got[0].b) < 170 and abs(len(got[0].a) / 19_996 - 0.125) < 0.01
    assert got[1].c == 0.0 and got[2].c is None and got[3].m == [] and got[2].m == got[2].a
    for r in got:
        joined = sorted({*r.a, *r.b})
        assert r.m == ([h for h in joined if h < "2"] or joined[:1])


def brute_whitening(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n = len(x)
    lifted = n * x - x.sum(0)
    z = (lifted / n).astype(float)
    values, w = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)
    return n, (lifted ** 2).sum(1), z, values[order], w[:, order]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)) * np.geomspace(50, 0.5, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 3000
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [None] + [0.0] * 11), (905, [1.0] * 5)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in bad] + [(None, x[0].tolist(), 2), (0, x[0].tolist(), 3)]
    got = whitening.by_component(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).toPandas()
    y = np.concatenate([x, x[[0, 0]]])
    n, deviation, z, values, w = brute_whitening(y)
    assert len(got) == 8 * n and (got.n == n).all() and (got.identity_error < 1e-9).all() and set(got.component) == set(range(1, 9))
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    for k in range(8):
        own = got[(got.component == k + 1) & got.vec_id.notna() & (got.vec_id != 0)].sort_values("vec_id")
        want = (z @ w[:, k] / np.sqrt(values[k]))[1:700]
        assert min(np.abs(own.whitened - s * want).max() for s in (1, -1)) < 1e-8
        assert np.abs(own.explained / (values[k] / values.sum()) - 1).max() < 1e-9


def test_whitening_of_dependent_dimensions(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(500, 3))
    x = np.c_[a * 100, a[:, 0] * 100, a[:, 1] * 50, np.full(500, 7.0), rng.normal(size=(500, 2)) * 0.004]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    basis = whitening.fit(whitening.usable(df, "vec_id", "embedding"))
    _, _, z, values, _ = brute_whitening(x)
    exact = np.linalg.svd(z, compute_uv=False) ** 2 / 500
    assert np.abs(basis.variances[:6] / exact[:6] - 1).max() < 1e-6 and basis.rounds > 3 and (basis.variances[6:] < 1e-12 * values[0]).all()
    assert np.abs(basis.components @ basis.components.T - np.eye(len(basis.components))).max() < 1e-12
    got = whitening.by_component(df).toPandas()
    assert (got.identity_error < 1e-4).all() and np.isfinite(got.whitened).all()


def test_whitening_of_small_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.by_component(spark.createDataFrame([], kind)).count() == 0
    assert whitening.by_component(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.by_component(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
    huge = whitening.by_component(spark.createDataFrame([(1, [1e300]), (2, [0.0]), (3, [1.0])], kind)).collect()
    assert {r.deviation for r in huge} == {None} and all(np.isfinite(r.whitened) for r in huge)


def brute_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                out.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_words():
    rnd = random.Random(1)
    for _ in range(1500):
        letters, w = rnd.choice([1, 2, 3, 5]), []
        while len(w) < rnd.choice([30, 60, 120]):
            period = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 4, 7, 9]))]
            w += (period * rnd.choice([1, 2, 3, 4, 9]))[:rnd.choice([5, 24, 25, 40, 99])]
        for least, times in ((24, 3), (6, 3), (5, 2)):
            want = brute_runs(w, least, times)
            assert sorted(runs.runs_of(w, least, times)) == want
            assert sorted((s, n, q) for s, q, n in runs.find_runs(np.array(w), least, times)) == want


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(told), sha(left))


def test_periodic_runs(spark, edge):
    rnd = random.Random(9)
    made = [(100 + i, " ".join(rnd.choice("ab") if i % 3 else f"v{rnd.randrange(30)}" for _ in range(rnd.choice([10, 80, 300])))) for i in range(150)]
    for table in (edge, spark.createDataFrame(made, "doc_id long, text string"), edge.limit(0)):
        table = table.filter("text is null or length(text) < 10000")
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = [tuple(r) for r in runs.digests(table).collect()]
        assert sorted(got, key=repr) == sorted((brute_digest(*r) for r in rows), key=repr)
    assert runs.collapsed(edge).filter("doc_id = 19").first().text == "a b"
    assert runs.digests(edge).count() == edge.count()
