"""Evaluators, link analysis, skew, URLs, HTML, crawl, sources and sinks, learning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexflume.functions import html as H
from lexflume.functions import urls as U
from lexflume.operators import crawl, evaluate, graph, ltr, skew, textclass
from lexflume.sources import readers, sinks

RUN = "query_id string, doc_id string, rank int, score double"
QRELS = "query_id string, assessor string, doc_id string, grade int"


def _run(spark, labels, query="q"):
    return spark.createDataFrame([(query, f"d{i}", i + 1, float(-i)) for i in range(len(labels))], RUN)


def _qrels(spark, labels, extra=0, query="q"):
    rows = [(query, "x", f"d{i}", g) for i, g in enumerate(labels) if g] + [(query, "x", f"m{i}", 1) for i in range(extra)]
    return spark.createDataFrame(rows, QRELS)


def test_binary_measures(spark):
    got = evaluate.evaluate_binary(_run(spark, [1, 0, 1]), _qrels(spark, [1, 0, 1])).first()
    assert got.ap == pytest.approx(0.833333333) and got.ndcg == pytest.approx(0.782021167) and got.r_precision == 0.5 and got.p_5 == pytest.approx(0.4)
    assert evaluate.evaluate_binary(_run(spark, [0, 1]), _qrels(spark, [0, 1])).first().ndcg == pytest.approx(1.442695041)
    assert evaluate.evaluate_binary(_run(spark, [0, 1, 1]), _qrels(spark, [0, 1, 1])).first().ndcg == pytest.approx(0.963253385)
    none = evaluate.evaluate_binary(_run(spark, [0, 0]), _qrels(spark, [1], query="other")).first()
    assert (none.ap, none.ndcg, none.n_rel, none.f1_5) == (0.0, 0.0, 0, 0.0)
    assert evaluate.evaluate_binary(_run(spark, []), _qrels(spark, [1])).count() == 0


def test_graded_measures(spark):
    got = evaluate.evaluate_graded(_run(spark, [2, 0, 1]), _qrels(spark, [2, 0, 1], extra=1)).first()
    assert got.ap == pytest.approx(0.75) and got.num_rel == 4 and got.r_precision == pytest.approx(0.75) and got.ip_0 == pytest.approx(2.0) and got.ip_10 == 0.0
    mean = evaluate.mean_over_queries(evaluate.evaluate_graded(_run(spark, [1]), _qrels(spark, [1]))).first()
    assert (mean.queries, mean.ap, mean.num_rel) == (1, 1.0, 1.0)


def test_curve_and_judgments(spark, rows):
    points = evaluate.pr_points(_run(spark, [1, 0, 1, 0]), _qrels(spark, [1, 0, 1, 0]))
    assert [(r.recall, r.precision) for r in points.orderBy("rank").collect()] == [(0.5, 1.0), (1.0, pytest.approx(2 / 3))]
    curve = {r.level: r.precision for r in evaluate.interpolated_curve(points).collect()}
    assert len(curve) == 11 and curve[0.0] == 1.0 and curve[1.0] == pytest.approx(2 / 3)
    added = evaluate.append_judgments(_qrels(spark, [1]), spark.createDataFrame([("q", "x", "d0", 2), ("q", "A B", "d9", 1)], QRELS))
    assert rows(added) == [("q", "A_B", "d9", 1), ("q", "x", "d0", 2)]


EDGES = [("A", "B"), ("A", "C"), ("A", "E"), ("B", "C"), ("C", "A"), ("D", "C")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([*EDGES, ("A", "B"), (None, "A"), ("A", None)], "src string, dst string").selectExpr("*", "1 AS node", "2 AS score")


def test_pagerank(spark, edges):
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"], "node string")
    got = {r.node: r.score for r in graph.pagerank(edges, nodes).collect()}
    wanted = {"A": 0.335170565, "B": 0.147132504, "C": 0.316793108, "D": 0.053771318, "E": 0.147132504}
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in wanted.items()) and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank(edges, nodes.limit(0)).count() == 0
    top = graph.top_scores(graph.pagerank(edges, nodes, iterations=1), "score", 2, edges.select("src", "dst").dropna().distinct()).collect()
    assert len(top) == 2 and top[0].inlinks == 3


def test_hits_and_base(spark, edges, rows):
    base = spark.createDataFrame([(x,) for x in "ABCDE"], "node string")
    plain = edges.dropna().select("src", "dst").distinct()
    one = {r.node: (r.authority, r.hub) for r in graph.hits(plain, base, iterations=1).collect()}
    assert one["C"][0] == pytest.approx(0.832050294) and one["A"][1] == pytest.approx(0.832050294) and one["B"][0] == pytest.approx(0.277350098)
    end = graph.hits(plain, base).agg(F.sum(F.col("authority") ** 2)).first()[0]
    assert end == pytest.approx(1)
    grown = graph.expand_base(plain, spark.createDataFrame([("B",)], "node string"), least=100)
    assert rows(grown) == [(x,) for x in "ABCDE"]
    many = spark.createDataFrame([(f"s{i}", "t") for i in range(30)], "src string, dst string")
    assert graph.expand_base(many, spark.createDataFrame([("t",)], "node string"), least=100, most_inlinks=5, most_rounds=1).count() == 6
    lists = spark.createDataFrame([("a", ["b", "b", None]), ("c", None), (None, ["x"])], "n string, l array<string>")
    assert rows(graph.edges_from_lists(lists, "n", "l")) == [("a", "b")] and rows(graph.edges_from_lists(lists, "n", "l", True)) == [("b", "a")]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_key_quantiles(spark, kind):
    rng = random.Random(6)
    data = [("hot", rng.choice([0, 1, 5, rng.randint(-1000, 10**9)])) for _ in range(4000)] + [("one", 7)] + [(f"k{i % 20}", rng.randint(0, 50)) for i in range(400)]
    data = [(k, float(v) / 3 if kind == "double" else v) for k, v in data] + [("hot", None), (None, 3 if kind == "long" else 3.0)]
    df = spark.createDataFrame(data, f"k string, v {kind}").selectExpr("*", "1 AS bucket", "2 AS p", "3 AS value")
    got = {(r.key, r.p): r.value for r in skew.key_quantiles(df, "k", "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    for key in {k for k, v in data if k and v is not None}:
        own = sorted(v for k, v in data if k == key and v is not None)
        for p in (0.0, 0.5, 0.9, 1.0):
            assert got[key, p] == own[max(1, math.ceil(p * len(own))) - 1]
    assert skew.key_quantiles(df.limit(0), "k", "v", (0.5,)).count() == 0


def test_key_quantiles_of_far_values(spark):
    values = [-1e308, 1e308, 0.0, -0.0, 1e-300, float("inf"), float("-inf"), float("nan"), 2.0, 2.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = {r.p: r.value for r in skew.key_quantiles(df, "k", "v", (0.1, 0.5, 0.7, 1.0)).collect()}
    own = sorted(v for v in values if not math.isnan(v))
    assert got == {p: own[max(1, math.ceil(p * len(own))) - 1] for p in (0.1, 0.5, 0.7, 1.0)}


def test_key_totals_and_links(spark, rows):
    df = spark.createDataFrame([("a", 60), ("a", 39), ("b", 1), ("c", 0), (None, 5), ("d", None)], "k string, v long").selectExpr("*", "1 AS key", "2 AS total")
    assert rows(skew.key_totals(df, "k", "v", 0.02)) == [("a", 2, 99, True), ("b", 1, 1, False), ("c", 1, 0, False)]
    assert skew.key_totals(df.limit(0), "k", "v").count() == 0
    pages = spark.createDataFrame([(["HTTP://A.Example:80/x#y", "https://a.example:443/x", "http://a.example:8080/x", None],), (None,), ([],), (["not a url#z"],)], "inlinks array<string>")
    assert rows(skew.key_totals(skew.link_entries(pages), "key", "entries")) == [("http://a.example/x", 2, 2, True), ("http://a.example:8080/x", 1, 1, True), ("not a url", 1, 1, True)]


def test_canonical_urls(spark):
    cases = [
        ("http://h.org/a/b/c", "/wiki/X", ""), ("http://h.org/a/b/c", "../x", "http://h.org/a/x"), ("http://h.org/a/b/c", "../../x", "http://h.org/x"),
        ("http://h.org/", "HTTPS://En.Site.ORG:443/A//b#c", "http://en.site.org/A/b"), ("http://h.org/", "http://h.org/pic.PNG", ""), ("http://h.org/", "http:\\\\/h.org\\p q", "http://h.org/pq"), ("http://h.org/", "\\\\h.org\\p q", ""), ("http://h.org/", "#top", ""), ("http://h.org/", None, None),
    ]
    df = spark.createDataFrame(cases, "base string, link string, wanted string")
    for r in df.withColumn("got", U.canonicalize(F.col("base"), F.col("link"))).collect():
        assert r.got == r.wanted, r
    more = df.withColumn("got", U.canonicalize(F.col("base"), F.col("link"), resolve_relative=True)).first()
    assert more.got == "http://h.org/wiki/X"
    keys = spark.createDataFrame([("HTTP://H.org:80//a/./b/../c#f",), ("http://h.org/../../x",), (None,)], "u string").select(U.index_key("u")).collect()
    assert [r[0] for r in keys] == ["http://h.org/a/c", "http://h.org/x", None]
    assert spark.range(1).select(U.domain(F.lit("http://a.b:80/c"))).first()[0] == "a.b:80"


def test_html(spark):
    page = "<html LANG='es-MX'><head><title>A &amp; B</title></head><body><p class=x>One <b>two</b>\n  three</p><P></P><p>last</p><pre>no</pre><a href='x.html'>x</a> <a class=\"q\" href=\"\">e</a><A id=1 HREF=\"y\">y</A></body></html>"
    r = spark.range(1).select(H.paragraphs(F.lit(page)).alias("p"), H.title(F.lit(page)).alias("t"), H.language(F.lit(page)).alias("l"), H.links(F.lit(page)).alias("a"), H.title(F.lit("<p>")).alias("none"), H.language(F.lit("<p>")).alias("en")).first()
    assert r.p == "One two three last " and r.t == "A & B" and r.l == "es-MX" and r.a == ["x.html", "y"] and r.none is None and r.en == "en"
    assert spark.range(1).select(H.admitted(F.lit("en-GB"), F.lit("http://x/y")), H.admitted(F.lit("fr"), F.lit("http://x/y")), H.admitted(F.lit("en"), F.lit("http://x/y.PDF"))).first() == (True, False, False)


def test_crawl(spark, rows):
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private\nCrawl-delay: 9", 200), ("b", "", 403), ("c", "", 500)], "domain string, body string, status int")
    urls = spark.createDataFrame([("http://a/x", "a"), ("http://a/private/x", "a"), ("http://b/x", "b"), ("http://c/x", "c"), ("http://d/x", "d")], "url string, domain string")
    assert rows(crawl.robots_rules(robots, urls)) == [("http://a/private/x", False, 3.0), ("http://a/x", True, 3.0), ("http://b/x", False, 1.0), ("http://c/x", True, 1.0), ("http://d/x", True, 1.0)]
    pages = spark.createDataFrame([(200, None), (404, "text/html"), (200, "image/png")], "status int, content_type string")
    assert crawl.fetchable(pages).count() == 1
    merged = crawl.merge_redirects(spark.createDataFrame([("o", ["a"]), ("f", ["b", "a"])], "url string, inlinks array<string>"), spark.createDataFrame([("o", "f")], "url string, final string"))
    assert rows(merged) == [("f", ["a", "b"])]
    wave = crawl.next_wave(spark.createDataFrame([("p", "http://storm"), ("q", "http://storm"), ("p", "http://x"), ("p", "k")], "src string, dst string"), spark.createDataFrame([("k",)], "url string"), 2).collect()
    assert [(r.url, r.wave, r.inlinks) for r in wave] == [("http://storm", 2, 2), ("http://x", 2, 1)] and wave[0].score == pytest.approx(math.exp(-1) + math.exp(-2))
    old = spark.createDataFrame([("u", "A", "old", ["x"], None), ("v", None, "c", None, None)], "url string, author string, content string, inlinks array<string>, outlinks array<string>")
    new = spark.createDataFrame([("u", "B", "new", ["y", "x"], ["z"]), ("w", "C", "n", None, None)], old.schema)
    assert {tuple(r)[:3] + (tuple(r.inlinks),) for r in crawl.upsert_pages(old, new).collect()} == {("u", "A, B", "new", ("x", "y")), ("v", None, "c", ()), ("w", "C", "n", ())}


def test_readers(spark, rows, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f1").write_bytes(b"<DOC>\n<DOCNO> A-1 </DOCNO>\n<TEXT>\nOne\ntwo\n</TEXT>\n<TEXT>caf\xe9</TEXT>\n</DOC>\n<DOC>\n<DOCNO>A-2</DOCNO>\n</DOC>\n")
    (tmp_path / "t" / "readme").write_text("<DOC><DOCNO>no</DOCNO></DOC>")
    assert rows(readers.read_trec(spark, str(tmp_path / "t"))) == [("A-1", "One two"), ("A-2", "")]
    assert rows(readers.read_trec(spark, str(tmp_path / "t"), last_text=True))[0] == ("A-1", "café")
    assert rows(readers.read_trec(spark, str(tmp_path / "t"), keep_markup_tail=True))[0][1].endswith("</TEXT>")
    (tmp_path / "crawl").write_text("<DOC>\n<DOCNO>http://u</DOCNO>\n<HEAD><TITLE>T</TITLE></HEAD>\n<TEXT>\nold\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>http://u</DOCNO>\n<HEAD><TITLE>T2</TITLE></HEAD>\n<TEXT>\nnew\n</TEXT>\n</DOC>\n")
    assert rows(readers.read_crawl_documents(spark, str(tmp_path / "crawl"))) == [("http://u", "T2", "new")]
    (tmp_path / "links").write_text('{"a": ["b"]}\n{"a": ["c", "d"], "e": []}\n\n')
    assert rows(readers.read_link_json(spark, str(tmp_path / "links"))) == [("a", ["c", "d"]), ("e", [])]
    (tmp_path / "adj").write_text("a b c b \nd\n")
    assert rows(readers.read_adjacency(spark, str(tmp_path / "adj"))) == [("a", ["b", "c"]), ("d", [])]
    (tmp_path / "q").write_text("51. one two.\n52. three\n\n53. four\n")
    assert rows(readers.read_queries(spark, str(tmp_path / "q"))) == [("51", "one two."), ("52", "three"), ("53", "four")]
    assert len(rows(readers.read_queries(spark, str(tmp_path / "q"), stop_at_blank=True))) == 2
    (tmp_path / "stop").write_text("the \nof\n\n")
    assert rows(readers.read_stopwords(spark, str(tmp_path / "stop"))) == [("of",), ("the",)]
    (tmp_path / "run").write_text("1 Q0 d1 1 2.5 Exp\n1  Q0\td2 x 1.5 Exp\n")
    assert rows(readers.read_run(spark, str(tmp_path / "run"))) == [("1", "Q0", "d1", 1, 2.5, "Exp"), ("1", "Q0", "d2", None, 1.5, "Exp")]
    (tmp_path / "qrels").write_text("1 x d1 0\n1 x d2 1\n")
    assert rows(readers.read_qrels(spark, str(tmp_path / "qrels"), binary=True)) == [("1", "x", "d2", 1)]


def test_mail(spark, rows, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "inmail.1").write_text("From: a\nSubject: Hi\n\nPlain text\n")
    (tmp_path / "m" / "inmail.2").write_text('Subject: Two\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/plain\n\nbody\n--b\nContent-Type: text/html\n\n<p>bo<b>ld</b></p>\n--b\nContent-Type: image/png\n\nxx\n--b--\n')
    (tmp_path / "index").write_text("spam ../data/inmail.1\nham ../data/inmail.2\n")
    got = {r.doc_id: (r.label, r.subject, r.body) for r in readers.read_mail_corpus(spark, str(tmp_path / "index"), str(tmp_path / "m")).collect()}
    assert got["1"] == ("spam", "Hi", "Plain text\n") and got["2"][:2] == ("ham", "Two") and "body" in got["2"][2] and "bold" in got["2"][2] and "xx" not in got["2"][2]
    nulls = spark.createDataFrame([(1, None), (2, "")], "id long, raw string")
    assert rows(readers.mail_parts(nulls, "id", "raw")) == [(1, None, None), (2, None, "")]


def test_sinks(spark, rows, tmp_path):
    run = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 2.0), ("1", "c", 2.0)], "query_id string, doc_id string, score double")
    assert [r.value for r in sinks.run_lines(run, k=2).orderBy("rank").collect()] == ["1 Q0 b 1 2.0 Exp", "1 Q0 c 2 2.0 Exp"]
    sinks.write_run(run, str(tmp_path / "run"))
    assert readers.read_run(spark, str(tmp_path / "run")).count() == 3
    sinks.write_qrels(spark.createDataFrame([("1", "A B", "d", 2)], QRELS), str(tmp_path / "q"))
    assert rows(readers.read_qrels(spark, str(tmp_path / "q"))) == [("1", "A_B", "d", 2)]
    docs = spark.createDataFrame([("http://u", "T", "some text"), ("http://v", None, None)], "url string, title string, text string")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert rows(readers.read_crawl_documents(spark, str(tmp_path / "docs"))) == [("http://u", "T", "some text"), ("http://v", "", "")]
    sinks.write_links(spark.createDataFrame([("a", ["b"]), ("c", None)], "url string, links array<string>"), str(tmp_path / "l"))
    assert rows(readers.read_link_json(spark, str(tmp_path / "l"))) == [("a", ["b"]), ("c", [])]
    assert sinks.score_lines(spark.createDataFrame([("n", 0.5, 1, 2)], "node string, score double, inlinks int, outlinks int")).first().value == "n\t0.5\toutlinks: 2\tinlinks: 1"
    vectors = ltr.assembled(spark.createDataFrame([(1, 0.5, 0.0)], "label int, a double, b double"), ["a", "b"])
    sinks.write_svmlight(vectors, str(tmp_path / "svm"))
    assert spark.read.format("libsvm").load(str(tmp_path / "svm")).count() == 1


def test_learning_to_rank(spark, rows):
    qrels = spark.createDataFrame([("1", "x", "a", 1), ("1", "x", "b", 0), ("2", "x", "c", 1)], QRELS)
    run = spark.createDataFrame([("1", "a", 1, 9.0), ("1", "d", 2, 8.0), ("1", "e", 3, 7.0), ("2", "f", 1, 6.0), ("9", "z", 1, 1.0)], RUN)
    assert rows(ltr.label_pairs(qrels, run, 2)) == [("1", "a", 0), ("1", "a", 1), ("1", "b", 0), ("2", "c", 1), ("2", "f", 0)]
    pairs = ltr.label_pairs(qrels, run, 2, exclude_relevant=True)
    feats = {(r.query_id, r.doc_id): (r.bm25, r.jm) for r in ltr.feature_frame(pairs, {"bm25": run, "jm": run}).collect()}
    assert feats["1", "a"] == (9.0, 9.0) and feats["1", "b"] == (0.0, -5000.0)
    scaled = ltr.robust_scaled(spark.createDataFrame([(float(i), 1.0) for i in range(5)], "x double, y double"), ["x", "y"])
    assert rows(scaled)[0] == (-0.5, 0.0) or (-1.0, 0.0) in rows(scaled)
    data = spark.createDataFrame([(f"q{i % 4}", f"d{i}", int(i % 2), float(i % 2) + 0.1 * (i % 3), 0.5) for i in range(40)], "query_id string, doc_id string, label int, a double, b double")
    out = ltr.cross_validated(data, ["a", "b"], folds=2, dimensions=20)
    assert out.count() == 40 and textclass.roc_auc(out.join(data, ["query_id", "doc_id"])).first().auc > 0.95


def test_text_classification(spark):
    docs = [(i, "win free money now" if i % 2 else "meeting notes of the day", "spam" if i % 2 else "ham") for i in range(40)] + [(99, None, None)]
    rows = textclass.with_tokens(textclass.labels_of(spark.createDataFrame(docs, "doc_id long, text string, mark string"), "mark"), "text").where("label IS NOT NULL")
    counted = textclass.fixed_counts(rows, textclass.VOCABULARY_A)
    assert counted.where("doc_id = 1").first().features.toArray()[textclass.VOCABULARY_A.index("free")] == 1
    grams = textclass.fixed_counts(textclass.with_ngrams(rows), ("free money",))
    assert grams.where("doc_id = 1").first().features.toArray().tolist() == [1.0]
    words = textclass.learned_counts(rows)
    data = words.transform(rows)
    for kind in ("logistic", "tree", "bayes"):
        model = textclass.classifier(kind, 40, c=1.0).fit(data)
        assert textclass.roc_auc(textclass.scored(model, data, "doc_id")).first().auc == 1.0
    odds = {r.word: r.log_odds for r in textclass.bayes_log_odds(rows, "doc_id").collect()}
    assert odds["free"] > 0 > odds["notes"]
    assert textclass.top_features(["a", "b"], [0.1, -0.9], 1) == [("b", -0.9)]
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert textclass.roc_auc(ties).first().auc == pytest.approx(0.875)
    train, test = textclass.split_rows(rows, "doc_id")
    assert train.count() + test.count() == 40
