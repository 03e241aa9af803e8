"""Texts cut within the first cell of a table row stay cut however many of them there are."""

from lexflume.llm import truncation

TABLE = "Levels on day {k}\nFort Vitas | {k}.5 m | 04:57\nSaint Bonet | 2.{k} m | 05:10\n"


def _cut(spark, texts):
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {r.doc for r in truncation.judged(df, "doc_id", "text", "source").where("cut").collect()}


def test_many_fragments_of_a_first_cell(spark):
    cut = [TABLE.format(k=k) + end for k in range(40) for end in ("Fort Vi", "Saint B", "Fo", "Saint Bonet")]
    whole = [TABLE.format(k=k) + "Forecaster Lee" for k in range(40)]
    assert _cut(spark, cut + whole) == set(range(len(cut)))


def test_an_ending_that_goes_on_elsewhere_is_no_known_line(spark):
    sentence = "The river board counted all the homes on the long pier"
    cut = [f"It rained on day {k}.\n{sentence[:40]}" for k in range(4)]
    whole = [f"It rained on day {k}.\n{sentence}." for k in range(4, 40)] + [f"It rained on day {k}.\nsigned off by the whole board" for k in range(4)]
    assert _cut(spark, cut + whole) == set(range(len(cut)))
