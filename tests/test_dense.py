"""Dense models rank all documents without multiplying them with the queries; canonical URLs stay in compiled code."""

import random
from math import log

import pytest
from pyspark.sql import functions as F

from lexflume.functions import urls
from lexflume.operators import ranking
from lexflume.operators.index import SearchIndex


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 2, 2, 3, 5, 8, 13, 40]))]) for i in range(90)]
    queries = [(1, ["a", "b", "a"]), (2, ["p"]), (3, ["zz"]), (4, ["c", "zz", "d", "e", "f"])]
    index = SearchIndex.build(spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(900, ""), (901, None)], "doc_id long, text string"), keep=True)
    asked = spark.createDataFrame([(q, n, t) for q, words in queries for n, t in enumerate(words)], "query_id int, qpos int, term string")
    return docs, queries, index, asked


@pytest.mark.parametrize("model", ["laplace", "jm"])
@pytest.mark.parametrize(("k", "digits"), [(1, 6), (7, 6), (7, 1), (25, 2), (1000, 6)])
def test_dense_models_equal_brute_force(collection, model, k, digits):
    docs, queries, index, asked = collection
    ttf, v = {}, len({t for _, w in docs for t in w})
    for _, words in docs:
        for t in words:
            ttf[t] = ttf.get(t, 0) + 1
    weight = {
        "laplace": lambda t, w: log((w.count(t) + 1) / (len(w) + v)),
        "jm": lambda t, w: log(1.1 * w.count(t) / len(w) + (1.1 - 1) * ttf.get(t, 100) / v),
    }[model]
    wanted = {}
    for q, words in queries:
        scored = sorted((-round(sum(weight(t, w) for t in words), digits), i) for i, w in docs)
        wanted[q] = [i for _, i in scored[:k]]
    got = {}
    for r in sorted(ranking.search(index, asked, model, k, digits=digits).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == wanted


def test_no_join_of_all_documents_with_all_queries(collection):
    _, _, index, asked = collection
    for model in ("laplace", "jm"):
        plan = ranking.search(index, asked, model, 5)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Cross") + plan.count("Join Inner\n") <= 1
        assert "GlobalLimit 5" in plan or model == "laplace"


def test_canonical_urls_compile(spark):
    conf, old = "spark.sql.codegen.fallback", spark.conf.get("spark.sql.codegen.fallback", "true")
    links = ["HTTPS://A.example:443//x//y#z", "//B.Example/p?q=1", "../up/x.html", "mailto:a@b.example", "a\\b", "", None, "http://c.example:8080/", "/wiki/X"]
    df = spark.createDataFrame([(x,) for x in links], "link string")
    try:
        spark.conf.set(conf, "false")
        got = [r[0] for r in df.select(urls.canonicalize(F.lit("http://base.example/a/b"), F.col("link"))).collect()]
    finally:
        spark.conf.set(conf, old)
    assert got == ["http://a.example/x/y", "//b.example/p?q=1", "http://base.example/up/x.html", "", "", "", None, "http://c.example80/", ""]
