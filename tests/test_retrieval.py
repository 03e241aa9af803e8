"""Analysis, index, ranking, proximity and feedback on micro-fixtures."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexflume.functions.analysis import Analyzer, porter_stem, stop_set
from lexflume.functions.porter import stem_word
from lexflume.functions.register import register_functions
from lexflume.operators import feedback, ranking
from lexflume.operators.index import SearchIndex, merge_postings, postings
from lexflume.operators.proximity import accumulate, visited_close

DOCS = [(1, "red storm red coast"), (2, "storm hit the coast of the north"), (3, "calm sea"), (4, ""), (5, None), (6, "storm storm storm sea sea wind")]
QUERIES = [(1, "red storm"), (2, "sea storm sea missing"), (3, "nothing")]


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.build(spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS pos"))


@pytest.fixture(scope="module")
def queries(spark):
    return Analyzer().queries(spark.createDataFrame(QUERIES, "query_id long, text string").withColumnRenamed("query_id", "id"), "id", "text")


def test_positions_count_marks_and_line_ends(spark, rows):
    df = spark.createDataFrame([(1, "The U.S. storm_1 hit\nNY"), (2, None), (None, "x")], "doc_id long, text string")
    assert [(t, p) for _, p, t in sorted(rows(Analyzer().tokens(df, "doc_id", "text")), key=lambda r: r[1])] == [("the", 0), ("u", 1), ("s", 3), ("hit", 6), ("ny", 8)]
    assert {r.term for r in Analyzer(positional=False).tokens(df, "doc_id", "text").collect()} == {"the", "u", "s", "storm_1", "hit", "ny"}
    assert {r.term for r in Analyzer(trailer=True).tokens(df, "doc_id", "text").collect()} >= {"ln"}
    assert {r.term for r in Analyzer(lowercase=False, stopwords=stop_set(["the"])).tokens(df, "doc_id", "text").collect()} == {"The", "U", "S", "hit", "NY"}
    assert {r.term for r in Analyzer(stopwords=stop_set(["thus"]), stop_mode="substring").tokens(df, "doc_id", "text").collect()} == {"the", "hit", "ny"}


def test_porter(spark):
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("generalizations", "gener"), ("oscillators", "oscil"), ("sky", "sky"), ("ion", "ion"), ("été", "été")):
        assert stem_word(word) == stem
    df = spark.createDataFrame([("storms",), (None,), ("storms",)], "t string")
    assert [r[0] for r in df.select(porter_stem("t")).collect()] == ["storm", None, "storm"]
    docs = spark.createDataFrame([(1, "running storms")], "doc_id long, text string")
    assert {r.term for r in Analyzer(stem=True).tokens(docs, "doc_id", "text").collect()} == {"run", "storm"}
    assert {r.term for r in Analyzer(double_stem=True, stopwords=stop_set(["the"])).tokens(docs, "doc_id", "text").collect()} == {"run", "storm"}


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT porter_stem('storms'), index_key('HTTP://A.org/x/../y#z'), word_list('Été a_b, x9'), url_domain('http://a.b:80/c'), url_host('http://a.b:80/c')").first()
    assert tuple(row) == ("storm", "http://a.org/y", ["Été", "a_b", "x9"], "a.b:80", "a.b:80")


def test_index_statistics(index, rows):
    assert rows(index.doc_stats) == [(1, 4), (2, 7), (3, 2), (6, 6)]
    stats = index.stats.first()
    assert (stats.n, stats.v, stats.sum_ttf) == (6, 10, 19) and stats.avgdl == pytest.approx(19 / 6)
    assert index.lookup(["red"]).first().positions == [0, 2]


def _score(tf, dl, avgdl, n, df, qtf, model):
    if model == "okapi_tf":
        return qtf * tf / (tf + 0.5 + 1.5 * dl / avgdl)
    if model == "tfidf":
        return qtf * tf / (tf + 0.5 + 1.5 * dl / avgdl) * math.log2(n / df)
    if model == "bm25_index":
        return math.log2((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * dl / avgdl)) * qtf * 2.2 / (qtf + 1.2)
    if model == "bm25_vectors":
        return qtf * math.log2((n + 0.5) / (df + 0.5)) * (tf + 1.2 * tf) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (qtf + 1.2 * qtf) / (qtf + 1.2)
    return qtf * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def _terms():
    return {d: t.split() for d, t in DOCS if t}


@pytest.mark.parametrize("model", ["okapi_tf", "tfidf", "bm25_index", "bm25_vectors", "match"])
def test_sparse_models(index, queries, model):
    texts = _terms()
    wanted = {}
    for q, text in QUERIES:
        for d, own in texts.items():
            hits = [w for w in set(text.split()) if w in own]
            if hits:
                wanted[q, d] = sum(_score(own.count(w), len(own), 19 / 6, 6, sum(w in t for t in texts.values()), text.split().count(w), model) for w in hits)
    got = {(r.query_id, r.doc_id): r.score for r in ranking.search(index, queries, model).collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], abs=1e-6) for k in got)


def test_published_values():
    assert _score(2, 10, 10, 4, 1, 1, "okapi_tf") == pytest.approx(0.5)
    assert _score(2, 10, 10, 4, 1, 1, "bm25_vectors") == pytest.approx(2.179323438)
    assert _score(2, 10, 10, 4, 1, 1, "bm25_index") == pytest.approx(1.746274888)
    assert _score(2, 10, 10, 4, 1, 1, "match") == pytest.approx(1.655462606)


def test_dense_models_equal_their_naive_form(index, queries):
    texts = _terms()
    ttf = lambda w: sum(t.count(w) for t in texts.values()) or 100
    for model, part in (("laplace", lambda tf, dl, w: math.log((tf + 1) / (dl + 10))), ("jm", lambda tf, dl, w: math.log(1.1 * tf / dl + (1.1 - 1) * ttf(w) / 10))):
        got = {(r.query_id, r.doc_id): r.score for r in ranking.search(index, queries, model).collect()}
        wanted = {(q, d): sum(part(own.count(w), len(own), w) for w in text.split()) for q, text in QUERIES for d, own in texts.items()}
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], abs=1e-5) for k in got)


def test_zero_fill_and_cut(index, queries):
    run = ranking.search(index, queries, "okapi_tf", k=4, zero_fill=True).collect()
    assert {q: sum(r.query_id == q for r in run) for q in (1, 2)} == {1: 4, 2: 4}
    assert all(r.rank <= 2 for r in ranking.search(index, queries, "okapi_tf", k=2).collect())


def test_proximity_walk(index, queries):
    assert visited_close([1, 5], [2, 9], 2) == 1
    assert visited_close([1], [2, 3], 2) == 3  # (1,2), then the rest against the last of the ended list: (1,2) again and (1,3)
    assert accumulate([[1, 5], [2, 9], [40]], 100) == [pytest.approx(1.326857131), pytest.approx(1.326857131), 0.0]
    base = {(r.query_id, r.doc_id): r.score for r in ranking.search(index, queries, "bm25_index").collect()}
    near = {(r.query_id, r.doc_id): r.score for r in ranking.search(index, queries, "proximity").collect()}
    assert near.keys() == base.keys() and near[1, 1] > base[1, 1] and near[1, 2] == pytest.approx(base[1, 2])


def test_merge_of_parts_is_the_whole(spark, rows, index):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    parts = [postings(Analyzer().tokens(docs.where(c), "doc_id", "text")) for c in ("doc_id < 3", "doc_id >= 3")]
    assert rows(merge_postings(*parts)) == rows(index.postings)
    both = [SearchIndex.build(docs.where(c)) for c in ("doc_id < 3", "doc_id >= 3")]
    assert rows(both[0].merge(both[1]).term_stats) == rows(index.term_stats)


def test_write_and_read(spark, rows, index, tmp_path):
    index.write(str(tmp_path / "ix"))
    again = SearchIndex.read(spark, str(tmp_path / "ix"))
    assert rows(again.postings) == rows(index.postings) and rows(again.stats) == rows(index.stats)


def test_vectors_and_empty_index(spark, queries):
    vectors = spark.createDataFrame([("a", "x", 2), ("a", "x", 2), ("a", None, 1), ("b", "x", 0), ("b", "y", 3)], "doc_id string, term string, term_freq long")
    index = SearchIndex.from_vectors(vectors)
    assert sorted((r.term, r.df, r.ttf) for r in index.term_stats.collect()) == [("x", 1, 2), ("y", 1, 3)]
    empty = SearchIndex.build(spark.createDataFrame([], "doc_id long, text string"))
    for model in ("bm25_vectors", "laplace", "jm", "proximity"):
        assert ranking.search(empty, queries, model).count() == 0


def test_feedback(spark, index, queries):
    run = ranking.search(index, queries, "bm25_vectors", 5)
    expanded = {r.query_id: r.terms for r in feedback.expand(index, run, queries).collect()}
    assert set(expanded) == {1, 2, 3} and expanded[3] == ["nothing"] and expanded[1][-2:] == ["red", "storm"] and len(expanded[1]) > 2
    got = feedback.significant_terms(index, queries, least_docs=1).collect()
    assert {(r.source_term, r.term) for r in got} >= {("red", "red"), ("sea", "calm")}
    kept = {r.query_id for r in feedback.expand_significant(index, queries, least_docs=1).collect()}
    assert kept == {1, 2}
    assert {r.query_id for r in feedback.expand_significant(index, queries, least_docs=1, keep_others=True).collect()} == {1, 2, 3}


def test_host_collapse(spark, rows):
    run = spark.createDataFrame([(1, "a", "h1", 3.0), (1, "b", "h1", 2.0), (1, "c", "h2", 1.0)], "query_id int, doc_id string, host string, score double")
    assert [r[1] for r in rows(ranking.collapse_hosts(run))] == ["a", "c"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8, unique=True), st.lists(st.integers(0, 40), min_size=1, max_size=8, unique=True))
def test_walk_against_a_second_form(left, right):
    left, right = sorted(left), sorted(right)
    i = j = n = 0
    while True:  # one pointer pair, an ended list keeps its last element
        if i >= len(left) and j >= len(right):
            break
        a, b = left[min(i, len(left) - 1)], right[min(j, len(right) - 1)]
        n += abs(a - b) <= 2
        if i < len(left) and (j >= len(right) or a < b):
            i += 1
        else:
            j += 1
    assert visited_close(left, right, 2) == n
