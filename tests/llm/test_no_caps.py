"""No class, rule, list or URL shape is cut off."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from phonrisk.llm import ann, langid, quality_rules, queries, url_rules


def test_many_languages_are_learned(spark):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rnd.choices(letters, k=5)) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(words[i % 300], k=40)), f"l{i % 300:03d}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count_distinct("lang_pred")).first()
    assert right[0] > 0.9 and right[1] > 256


def test_sampled_languages_keep_their_share(spark):
    rows = [(i, "same words for all", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_of = (langid.identify(docs, sample=k).first() for k in (200, 100_000))
    assert few.lang_pred == all_of.lang_pred == "big" and abs(few.score - 0.9) < 0.1 and abs(all_of.score - 0.9) < 0.1


def test_slots_shared_by_buckets(monkeypatch):
    at, counts = langid.features("some words of a text")
    idf = np.ones(1 << langid.DIM_BITS)
    whole, folded = langid.weighed(at, counts, idf), langid.weighed(at, counts, idf, 64)
    assert (np.diff(folded[0]) > 0).all() and folded[0].max() < 64 and abs(folded[1].sum() - whole[1].sum()) < 1e-9


def test_rules_go_on_after_one_that_fails():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 3))
    bad = np.zeros(6000, bool)
    for k in range(12):  # twelve separate kinds of bad rows, more than a short list could name
        bad |= (x[:, 0] > k / 12) & (x[:, 0] < k / 12 + 0.03) & (x[:, 1] > 0.5)
    bad |= rng.random(6000) < 0.01
    rules = quality_rules.learn_rules(x, bad, ["a", "b", "c"], np.arange(6000) % 3 == 0)
    covered = np.zeros(6000, bool)
    for r in rules:
        covered |= quality_rules._holds(x, ["a", "b", "c"], r)
    assert len(rules) > 8 and bad[covered].mean() > 0.85 and covered[bad].mean() > 0.6


def test_probes_open_all_lists_within_reach():
    centres = np.random.default_rng(0).normal(size=(200, 4))
    graph = ann.CentroidGraph(centres)
    x = np.zeros((3, 4))
    x[1] += 100
    dist = np.sqrt(((centres[None] - x[:, None]) ** 2).sum(2))
    unit = np.sort(dist, 1)[:, :ann.NEAREST_FEW].mean(1)
    got = ann._within(graph, x, 1.2, 2)
    assert [sorted(g) for g in got] == [np.flatnonzero(d <= 1.2 * u).tolist() for d, u in zip(dist, unit)] and len(got[1]) == 200


def test_shared_url_shapes_do_not_multiply(spark):
    shape = "/".join(f"{c}long{c}" for c in "abcdefghijklmnopqrstuvw")
    urls = [(f"http://one.deep.site.example.org/{shape}/{i}", True) for i in range(25)] + [(f"http://fine{i % 7}.example.net/alpha/{i}", False) for i in range(400)]
    urls += [(f"http://mixed.example.net/x/{'p' if i % 2 else 'r'}/{'q' if i // 2 % 2 else 's'}/{i}", i % 4 == 3) for i in range(300)]
    start = time.time()
    got = [(r["first"], *r["rest"]) for r in url_rules.mine(spark.createDataFrame(urls, "url string, blocked boolean")).collect()]
    assert time.time() - start < 60
    assert ("path word=alonga",) in got and ("host=one.deep.site.example.org",) in got
    assert ("path word=p", "path word=q") in got and ("path word=p",) not in got and len(got) == len(set(got))


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    urls = [(f"http://a.example.net/{'p/pp' if i % 2 else 'r'}/{'q/qq' if i // 2 % 2 else 's'}/{i}", i % 4 == 3) for i in range(600)]
    got = {(r["first"], *r["rest"]) for r in url_rules.mine(spark.createDataFrame(urls, "url string, blocked boolean")).collect()}
    assert {(f"path word={a}", f"path word={b}") for a in ("p", "pp") for b in ("q", "qq")} <= got


def test_the_sharding_query_splits(spark):
    got = queries.QUERIES["op10_sharding"](spark, "/root/testdata/sf0.001")
    assert got.select("shard").distinct().count() > 1 and got.filter("oversized").isEmpty()
