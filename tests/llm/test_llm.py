"""Training-data operators against brute force, libraries, oracles and planted cases; edge cases of each."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phonrisk.llm import ann, bpe, components, langid, line_dedup, mixing, ngram_join, quality_rules, queries, sharding, toxicity, url_rules

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id_key string, m long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(4000)]
    long = " ".join(rnd.choices(words, k=30_000))
    base = rnd.choices(words, k=120)
    near = [base[:k] + ["x%d" % k] + base[k + 1:] for k in (3, 60, 110)]
    texts = [None, "", " \n\t", "one two", "One  two", long, long, *(" ".join(x) for x in (base, *near)), "a b c d e\nshared line here\nz", "shared line here\nq"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 7}", None, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, " ".join(base), None, None, None, None, None), (7, "other text under a used id", "en", "s1", 3, "y", 2)]
    return spark.createDataFrame(rows, DOCS)


def test_oracles(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
        assert rows == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr), name


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group)]


def test_ngram_join(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, edge):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = [tuple(r) for r in ngram_join.link_components(table).collect()]
        assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "11", "12", "2", "3", "5", "7", "7"]
    assert ngram_join.link_components(edge.limit(0)).count() == 0


def test_star_without_its_centre_is_still_one_component(spark):
    words = ["c%d" % i for i in range(400)]
    rnd = random.Random(1)
    rows = [(0, " ".join(words))]
    for i in range(1, 40):  # each near the centre, most too far from each other
        w = list(words)
        for at in rnd.sample(range(0, 400, 20), 7):
            w[at] = f"n{i}-{at}"
        rows.append((i, " ".join(w)))
    got = [tuple(r) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows)) and {r[2] for r in got} == {0}


def test_lists_that_may_be_hot_give_the_same_groups(spark, edge, monkeypatch):
    want = sorted((tuple(r) for r in ngram_join.link_components(edge).collect()), key=repr)
    monkeypatch.setattr(ngram_join, "SHORT_LEVEL", -1)
    assert sorted((tuple(r) for r in ngram_join.link_components(edge).collect()), key=repr) == want


def test_a_null_id_is_not_minus_one(spark):
    text = "one two three four five six"
    rows = spark.createDataFrame([(-1, text), (None, text), (-1, text), (None, ""), (-1, ""), (-1, "")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(rows).collect()), key=repr)
    assert kept == sorted([(-1, text), (None, ""), (-1, "")], key=repr)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_bpe_equals_the_library_and_decodes(spark, edge):
    import hashlib
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rnd = bpe.Codec(ranks, P.PATTERN), random.Random(2)
    alphabet = "abcdefghijABC éüß中文日本語ñ \n\t0123!?.,'’😀العربية"
    for text in ["".join(rnd.choices(alphabet, k=rnd.choice([1, 6, 50, 300]))) for _ in range(400)] + ["a" * 3000, "thethe" * 200, " " * 300]:
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    got = bpe.digests(edge, VOCABULARY, P.PATTERN).collect()
    want = [library.encode_ordinary(r.text or "") for r in edge.collect()]
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest() for w in want)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in edge.collect())
    back = bpe.with_ids(edge, VOCABULARY, P.PATTERN, ["doc_id", "text"]).withColumn("b", bpe.decoder(spark, VOCABULARY, P.PATTERN)("input_ids"))
    assert all(bytes(r.b).decode() == (r.text or "") for r in back.collect())
    assert bpe.digests(edge.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_language_id(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] and got[2] <= 1
    rows = {r.doc_id: r.lang_pred for r in langid.identify(edge).collect()}
    assert rows[0] == rows[1] == rows[2] == "und" and rows[5] == "en"
    assert langid.accepted(edge).columns == edge.columns and langid.identify(edge.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").toPandas()
    rank, bad = got.score.rank(), got.toxic == 1
    assert (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.8
    assert got.predicted[~bad].mean() < 0.01 < got.predicted[bad].mean()
    none = labels.limit(0)
    assert toxicity.score(edge, none).filter("predicted = 0").count() == edge.count() and toxicity.score(edge.limit(0), labels).count() == 0


def test_toxicity_scores_keep_their_meaning_when_both_labels_are_sampled(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels, sample=200).join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").toPandas()
    bad = got.toxic == 1
    assert got.predicted[~bad].mean() < 0.01 and got.predicted[bad].mean() > 0.5
    *_, bias = toxicity.fit(docs, labels, sample=200)
    assert 1 / (1 + np.exp(-bias)) < 0.3  # what an empty text scores; toxic labels are an eighth


def brute_repeats(words):
    w = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, x in enumerate(w) if w.count(x) > 1 for k in range(3)})


def test_quality_rules(spark, edge):
    rnd = random.Random(4)
    for n in (0, 2, 3, 4, 9, 40):
        words = [rnd.choice("abc").encode() for _ in range(n)]
        assert quality_rules.repeat_words(words) == brute_repeats(words)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs, labels).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99 and got.kept[got.quality == 0].mean() < 0.2
    rows = {r.doc_id: r for r in quality_rules.judge(edge, labels.limit(0)).collect() if r.doc_id in (0, 5)}
    assert rows[0].base_failed and not rows[0].kept and rows[5].n_words == 30_000 and rows[5].kept
    assert quality_rules.judge(edge.limit(0), labels).count() == 0


def test_line_dedup(spark, edge):
    rows = [(i, f"own {i}\nbanner of all sites\nend {i}", f"s{i % 8}", "x") for i in range(40)] + [(99, "banner of all sites", None, None), (None, None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert got[0] == rows[0][1] and got[1] == "own 1\nend 1" and got[99] == "" and got[None] is None
    assert line_dedup.drop_lines(edge, 2).count() == edge.count() and line_dedup.drop_lines(edge).columns == edge.columns
    assert line_dedup.report(edge.limit(0)).count() == 0


def test_mixing(spark, edge):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 9, 30, 700])), rnd.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * 700 and g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-6
    assert abs(got.groupby("source", dropna=False).target.first().sum() - got["size"].sum()) < 1e-3
    assert mixing.mixed_rows(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0] == got.taken.sum()
    assert mixing.mix(edge).count() == edge.count() and mixing.mixed_rows(edge).columns == edge.columns
    assert mixing.mix(edge.limit(0)).count() == 0


def test_sharding(spark, edge, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 97)) for i in range(4000)], "doc_id long, text string")
    got = sharding.assign_shards(docs, 5_000).toPandas()
    total = got.groupby("shard").bytes.sum()
    assert len(got) == 4000 and (total <= 5_000).all() and (total.loc[got["shard"]].to_numpy() == got.shard_bytes).all()
    parents = got.assign(p=got["shard"].str[:-1])
    assert all(got.bytes[got["shard"].str.startswith(p)].sum() > 5_000 for p in parents.p.unique())
    deep = sharding.assign_shards(docs, 5_000).count(), sharding.assign_shards(edge, 50).toPandas()
    assert deep[0] == 4000 and len(deep[1]) == edge.count() and deep[1].oversized.any()
    sharding.write_shards(docs, str(tmp_path / "shards"), 50_000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 4000
    assert sharding.assign_shards(edge.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [(i, f"http://shop{i % 9}.example.org/{'win' if i % 3 == 0 else 'read'}/{i}") for i in range(300)]
    labelled = spark.createDataFrame([(u, "/win/" in u) for _, u in urls], "url string, blocked boolean")
    pages = spark.createDataFrame([*urls, (900, None), (901, "no scheme"), (902, "http://NEW.example.net/win/1"), (903, "https://a.example.com/en/1?x=/b#c"), (904, "x://www.example.com/en/"), (904, "x://com")], "page_id long, url string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/")]
    got = {r.page_id: r for r in url_rules.judge(pages, rules, labelled).collect()}
    assert all(got[i].verdict == ("block" if "/win/" in u else "allow") for i, u in urls)
    assert got[900].host == got[901].host == "" and got[900].verdict == "allow"
    assert got[902].host == "new.example.net" and got[902].verdict == "block"
    assert (got[903].path, got[903].rule, got[903].verdict) == ("/en/1", "example.com/en/", "block")
    assert url_rules.judge(pages, rules, labelled.limit(0)).count() == pages.count()
    assert url_rules.judge(pages.limit(0), rules, labelled).count() == 0


def test_url_rules_need_a_count_not_a_share(spark):
    urls = [f"http://bad.example.org/a/{i}" for i in range(25)] + [f"http://fine{i % 7}.example.net/b/{i}" for i in range(30_000)]
    labelled = spark.createDataFrame([(u, "//bad." in u) for u in urls], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://bad.example.org/new"), (2, "http://fine1.example.net/new")], "page_id long, url string")
    for bound in (10_000, 0):  # broadcast and plain join
        got = {r.page_id: r.verdict for r in url_rules.judge(pages, [], labelled, broadcast_rules=bound).collect()}
        assert got == {1: "block", 2: "allow"}


def test_rules_implied_by_shorter_ones_go(spark):
    sets = [["a"], ["a", "b"], ["b", "c"], ["b", "c", "d"], ["d", "e", "f"], ["c", "e"], ["a", "x", "y"]]
    got = url_rules.shortest(spark.createDataFrame([(s, 0.9) for s in sets], "items array<string>, confidence double"))
    assert sorted(r["items"] for r in got.collect()) == [["a"], ["b", "c"], ["c", "e"], ["d", "e", "f"]]
    mined = url_rules.mine(spark.createDataFrame([(f"http://s{i % 9}.example.org/{'win' if i % 3 == 0 else 'read'}/{i}", i % 3 == 0) for i in range(300)], "url string, blocked boolean"))
    assert [(r["first"], r["rest"]) for r in mined.collect() if "word=win" in r["first"]] == [("path word=win", [])]
    assert not [r for r in mined.collect() if "path word=win" in r["rest"]]


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(700, 8)) + 6 * rng.normal(size=8) for _ in range(6)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [])]
    rows += [(9100 + i, x[0].tolist()) for i in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id % 100 = 0")).toPandas()
    ids, y = np.array([r[0] for r in rows if r[0] < 9000 or r[0] >= 9100]), np.concatenate([x, x[[0, 0, 0]]])
    hits = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((y - y[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(true) & set(g.vec_id)), total + 10
        assert g.sort_values("rank").score.is_monotonic_increasing and len(g) == 10
    assert hits >= 0.9 * total and got.query_id.nunique() == 43
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist()[:3] == [9100, 9101, 9102]
    few = vectors.filter("vec_id < 3")
    assert ann.search(few, few).count() == 6 and ann.search(vectors.limit(0), vectors).count() == 0


def test_pipeline(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "lang", "source", "input_ids", "n_tokens"} == set(out.columns) and out.count() > 0.5 * docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (edge, edge.limit(0)):
            assert stage(spark, table, SF).columns == edge.columns
            stage(spark, table, SF).count()
