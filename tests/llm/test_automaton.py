"""The stack automaton over whole texts, and what it decides."""

import pytest

from lexflume.llm import truncation

OPEN = {
    'She said "we will leave at dawn.': ['"'],
    "The list (see below.\n\nAll was well in the end.": ["("],
    "<div><p>The storm hit.": ["div"],
    "He asked „warum and left.": ["„"],
    "<b>Bold (and [nested words.": ["b", "(", "["],
    "<!-- a note that never ends.": ["<!--"],
}
INSIDE = ("Read <a href='x", "Fish &amp", "A path C:\\u00e", "100%2", "A broken \ufffd", "Then </di")
CLOSED = (
    'She said "we leave." Then "we left."', "(a) one, b) two, (c (d)) three.", "<p>One<br>two <i>three</i>.", "A 5\" nail and a smile :( here.", "«Oui», dit-il.", "„Ja“, sagte er.", "“Yes,” they said.",
    "AT&T sold 100% of it.", "3 < 5 and a\\nb.", "", "<!-- a note --> text.", '("quoted) text.',
)


@pytest.mark.parametrize("text", OPEN)
def test_openers_without_closers_stay_on_the_stack(text):
    assert truncation.automaton(text) == (OPEN[text], "")


@pytest.mark.parametrize("text", INSIDE)
def test_unfinished_signs(text):
    assert truncation.automaton(text)[1]


@pytest.mark.parametrize("text", CLOSED)
def test_closed_texts(text):
    assert truncation.automaton(text) == ([], "")


def _cut(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").selectExpr("*", "1 AS doc", "'x' AS unclosed", "2 AS verdict")
    return {r.doc for r in truncation.judged(df, "doc_id", "text", "source").where("cut").collect()}


def test_the_automaton_decides_where_the_end_looks_whole(spark):
    """Each of these ends with a terminator: only the automaton sees the cut. Ids are texts."""
    assert all(truncation.by_end(t)[0] == truncation.WHOLE for t in OPEN)
    assert _cut(spark, [(f"d{k}", t, "s") for k, t in enumerate([*OPEN, *CLOSED[:5]])]) == {f"d{k}" for k in range(len(OPEN))}


def test_what_a_source_leaves_open_as_a_rule_is_no_cut(spark):
    loose = [(f"l{k}", f"<div>Day {k} was dry.", "loose") for k in range(30)]
    strict = [(f"s{k}", f"<div>Day {k} was dry.</div>" if k else "<div>Day 0 was dry.", "strict") for k in range(30)]
    assert _cut(spark, loose + strict) == {"s0"}


def test_a_source_that_never_sets_terminators(spark):
    sheets = [(f"t{k}", f"Level of gauge {k} today\nheight {'abcdefgh'[k % 8] * 3} metres and {k} more\nwater {'xyz'[k % 3] * 2} brown", "sheets") for k in range(40)]
    prose = [(f"p{k}", f"It rained on day {k}. The river rose by {k} feet.", "prose") for k in range(39)] + [("p39", "It rained on day 39. The river rose by many fe", "prose")]
    assert _cut(spark, sheets + prose) == {"p39"}


def test_headlines_of_any_length_and_cut_ones(spark):
    places = ("harbour", "chapel", "bridge")
    prose = [(f"p{k}", f"They met near the old {places[k % 3]}. Then the wind came from the {places[(k + 1) % 3]}.", "prose") for k in range(120)]
    long = "A very long headline without any end of a sentence that tells of the storm and of the people by the old bridge"
    rows = [("h1", "How the town rebuilt its chapel", "prose"), ("h2", long, "prose"), ("c1", "How the town rebuilt the", "prose"), ("c2", "How the town rebuilt its brid", "prose"), ("c3", long[:-5], "prose")]
    assert _cut(spark, prose + rows) == {"c1", "c2", "c3"}
