"""Rank fusion, top items, term statistics, encoding, truncation."""

import base64
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexflume.llm import encode, rank_fusion, terms, top_items, truncation

RUN = "query_id string, doc_id string, score double"


def _chain(scores, damping):
    """The walk by its transition matrix."""
    n, runs = scores.shape
    m = np.zeros((n, n))
    for k in range(runs):
        for i in range(n):
            up = scores[:, k] >= scores[i, k]
            m[i, up] += 1 / up.sum() / runs
    share = np.full(n, 1 / n)
    for _ in range(500):
        share = (1 - damping) / n + damping * share @ m
    return share


def test_walk_equals_transition_matrix():
    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 6, (n, 3)).astype(float) for n in (1, 7, 30)]
    got = rank_fusion.stationary(np.vstack(groups), np.cumsum([0, 1, 7, 30]), 0.6, 1e-14)
    assert np.allclose(got, np.concatenate([_chain(g, 0.6) for g in groups]), atol=1e-10)


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(4)
    out = []
    for scale in (1, 1000, -0.01):
        data = [(f"q{g}", f"d{i:03}", float(scale * (i % 17) + rng.normal() * abs(scale))) for g, n in ((0, 90), (1, 25), (2, 3)) for i in range(n)]
        data += [("q0", "d000", None), ("q0", "d001", float("nan")), ("q0", "d002", -1e9), ("q1", data[90][1], data[90][2]), (None, "d", 1.0), ("q3", None, 1.0), ("q4", "lone", 1.0)][: 7 if scale == 1 else 6]
        out.append(spark.createDataFrame(data, RUN).selectExpr("*", "1 AS rank", "'x' AS grp", "0.5 AS share"))
    return out


def test_fusion_and_its_distributed_form_agree(runs):
    whole = rank_fusion.fuse_rankings(runs, "query_id", "doc_id", top=5)
    split = rank_fusion.fuse_rankings(runs, "query_id", "doc_id", top=5, whole=20, tolerance=1e-7)
    key = lambda df: sorted((r.grp, r.rank, r.item) for r in df.collect())
    assert key(whole) == key(split)
    assert {r.grp for r in whole.collect()} == {"q0", "q1", "q2"}
    assert rank_fusion.fuse_rankings([r.limit(0) for r in runs], "query_id", "doc_id").count() == 0
    assert {r.grp for r in rank_fusion.fuse_rankings(runs, "query_id", "doc_id", least_items=20).collect()} == {"q0", "q1"}


def _top(data, n):
    best = defaultdict(dict)
    for q, d, s in data:
        if q is not None and d is not None and s is not None and not math.isnan(s):
            best[q][d] = max(s, best[q].get(d, -math.inf))
    return {(q, d, r + 1) for q, own in best.items() for r, (d, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("heavy", [10, 100_000])
def test_top_items(spark, heavy):
    rng = np.random.default_rng(1)
    data = [("hot", f"d{i}", float(rng.integers(0, 40))) for i in range(3000)] + [("ties", f"t{i}", 1.0) for i in range(200)] + [("few", "a", 1.0), ("few", "b", None), ("few", "c", float("nan")), ("few", "a", 3.0), ("inf", "x", math.inf), ("inf", "y", -math.inf), *(("inf", f"z{i}", float(i)) for i in range(30)), (None, "d", 1.0), ("n", None, 1.0)]
    df = spark.createDataFrame(data + data[:50], RUN).selectExpr("*", "9 AS part", "9 AS salt", "9 AS item")
    found = top_items.top_per_group(df, "query_id", "doc_id", "score", 10, heavy=heavy)
    assert {(r.grp, r.item, r.rank) for r in found.collect()} == _top(data, 10)
    assert top_items.top_per_group(df.limit(0), "query_id", "doc_id", "score", 10, heavy=heavy).count() == 0


VECTORS = [("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("b", "z", 5), ("c", "x", 2), ("c", "y", 2), ("c", "y", 2), ("d", "", 4), ("d", None, 4), ("d", "x", 0), ("d", "w", None), (None, "x", 7)]


def test_term_frequencies_and_divergence(spark):
    df = spark.createDataFrame(VECTORS, "doc_id string, term string, term_freq long").selectExpr("*", "99 AS doc_freq", "99 AS docs", "1 AS total")
    got = {r.term: (r.occurrences, r.docs, r.mark) for r in terms.term_frequencies(df).collect()}
    assert got == {"x": (6, 3, "common"), "y": (3, 2, "rare"), "z": (5, 1, "rare")}
    lead = {r.doc: r.term for r in terms.leading_terms(df).collect()}
    assert lead == {"a": "y", "b": "x", "c": "y"} or lead["c"] == "y"
    size, ttf, length = 14, {"x": 6, "y": 3}, {"a": 4, "b": 6, "c": 4}
    for r in terms.term_divergence(df, mu=10).collect():
        bg = ttf[r.term] / size
        own = (r.tf + 10 * bg) / (length[r.doc] + 10)
        assert r.divergence == pytest.approx(own * math.log2(own / bg))
    assert terms.term_frequencies(df.limit(0)).count() == 0 and terms.leading_terms(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(encode.vocabulary_path(), "rb") as f:
        return encode.TrieEncoder(f.read())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(encode.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_encoding_equals_library(encoder, reference, text):
    ids, _ = encoder.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)


def test_encode_corpus(spark, reference):
    texts = [None, "", " ", "Hello world, hello worlds", "<|endoftext|> as text", "naïve 🌀🌀 日本語\r\n\t x", "a" * 5000 + " " * 300 + "!?" * 200, "Hello world, hello worlds"]
    df = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS ids")
    got = Counter((r.id, tuple(r.ids)) for r in encode.encode_corpus(df, "doc_id", "text").collect())
    assert got == Counter((i if i != 4 else None, tuple(reference.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("All is well.", truncation.WHOLE), ("Was it? (Yes.)", truncation.WHOLE), ("He left. (edited)", truncation.WHOLE), ("Calm at last! 🙂", truncation.WHOLE), ("It ended. :)", truncation.WHOLE),
        ("It rained. #storm", truncation.WHOLE), ("Rows\nA | 1.2 m | 10:00\nB | 2.2 m | 11:30", truncation.WHOLE), ("Rows\nA | 1.2 m | 10:00\nB | 2.2 m | 11:3", truncation.CUT),
        ("Rows\nA | 1.2 m | 10:00\nB | 2.", truncation.CUT), ("We saw the br�", truncation.CUT), ("Nobody expected it&qu", truncation.CUT), ("He said \"we go,\"", truncation.CUT), ("They went (all of them)", truncation.CUT),
        ("It went on...", truncation.OMISSION), ("The mill [...]", truncation.OMISSION), ("Nobody in Upper", truncation.OPEN), ("", truncation.WHOLE), (" \n ", truncation.WHOLE), ("She said (it was late.", truncation.CUT),
    ],
)
def test_endings(text, verdict):
    assert truncation.ending(text)[0] == verdict


def test_judged(spark):
    whole = [f"The {w} tide rose fast over town {k}.\nsigned off" for k, w in enumerate(("red", "blue", "grey", "pale"))] + [f"It rose at dawn {k}. And then nothing... :)" for k in "ab"]
    thought, cut = "We waited long. And then nothing...", ["The river board counted all the homes without any power, mostly so", "One road was closed. The oth...", "Nobody in the town or on the long pier expected the rain to last until"]
    texts = [*whole, thought, "A short headline", *cut, None, "", "  "]
    limit = [(f"{'x' * k} rain fell on the long pier and all went ho").ljust(60, "z")[:60] for k in range(5)]
    full = "This one just fills the limit of the field and has no mor".ljust(59, "e") + "."
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(100 + i, t, "b") for i, t in enumerate(limit)] + [(200, full, "b"), (300, cut[0], None), (None, cut[0], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS doc", "2 AS copy", "3 AS cut")
    got = truncation.judged(df, "doc_id", "text", "source")
    found = {r.doc for r in got.where("cut").collect()}
    at = len(whole) + 2
    assert found == {at, at + 1, at + 2, 100, 101, 102, 103, 104, 300, None}
    assert got.count() == len(rows)
    rates = {r.source: (r.records, r.cut) for r in truncation.truncation_rates(got).collect()}
    assert rates["b"] == (6, 5) and rates[None] == (1, 1)
    assert truncation.judged(df.limit(0), "doc_id", "text", "source").count() == 0


def test_a_walk_that_does_not_settle_is_an_error():
    with pytest.raises(RuntimeError):
        rank_fusion.stationary(np.array([[1.0], [2.0], [3.0]]), np.array([0, 3]), most_steps=2)
