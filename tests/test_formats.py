"""Readers of split files, sinks, entities, percentiles, and the vectorised proximity sums against the walk."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexflume.functions import html
from lexflume.operators import ltr
from lexflume.operators.proximity import accumulate, close_pairs
from lexflume.sources import readers, sinks


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "500")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_file_is_read_by_several_tasks_and_the_last_line_counts(spark, tmp_path, small_splits):
    path = tmp_path / "links.json"
    path.write_text("".join(f'{{"u{k % 50}": ["l{k}"]}}\n' for k in range(400)))
    lines = readers._lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 3
    assert {r.url: r.links for r in readers.read_link_json(spark, str(path)).collect()} == {f"u{k}": [f"l{k + 350}"] for k in range(50)}


def test_trec_blocks_across_splits(spark, tmp_path, small_splits):
    whole = "".join(f"<DOC>\n<DOCNO> d{k} </DOCNO>\n<TEXT>\n{'café ' * 30}{k}\n</TEXT>\n</DOC>\n" for k in range(40))
    (tmp_path / "one").write_bytes(whole.encode("latin-1"))
    (tmp_path / "readme").write_bytes(whole.encode("latin-1"))
    got = {r.doc_id: r.text for r in readers.read_trec(spark, str(tmp_path)).collect()}
    assert got == {f"d{k}": "café " * 30 + str(k) for k in range(40)}


def test_numbered_judgments_and_scores(spark, tmp_path):
    (tmp_path / "q").write_text("1 a d1 2\n1 a d1 0\n1 a d2 1\n")
    rows = readers.read_qrels(spark, str(tmp_path / "q"), numbered=True)
    assert [r.grade for r in rows.orderBy("at").collect()] == [2, 0, 1]
    scores = spark.range(30).selectExpr("concat('n', id) AS node", "CAST(id AS DOUBLE) AS score")
    sinks.write_scores(scores, str(tmp_path / "few"), 3)
    sinks.write_scores(scores, str(tmp_path / "all"), None)
    assert [r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "few")).collect()] == ["n29", "n28", "n27"]
    assert spark.read.text(str(tmp_path / "all")).count() == 30


def test_entities_and_bare_links(spark):
    page = "<p>A&#233;&#xE9; &amp;#65; &nbsp;&#0;&#x1F300;&lt;b&gt;</p><a href=/x/y?z=1&amp;q=2>one</a><a class=c href='k'>two</a><a href=\"\">none</a>"
    row = spark.createDataFrame([(page,), (None,)], "html string").select(html.paragraphs(F.col("html")).alias("p"), html.links(F.col("html")).alias("l")).collect()
    assert row[0].p == "Aéé &#65;  �🌀<b> " and row[0].l == ["/x/y?z=1&q=2", "k"]
    assert row[1].l is None


def test_percentiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 9), float(rng.randint(0, 3)), None) for _ in range(501)] + [(float("nan"), None, None)]
    found = ltr.percentiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], (0.0, 0.25, 0.5, 0.9, 1.0))
    for at, c in enumerate("ab"):
        assert found[c] == pytest.approx(list(np.quantile([r[at] for r in rows[:501]], [0.0, 0.25, 0.5, 0.9, 1.0])))
    assert found["c"] == [None] * 5


def test_proximity_sums_equal_the_walk():
    rng = random.Random(5)
    rows, sizes = [], []
    for _ in range(300):
        places = rng.sample(range(60), rng.randint(1, 40))
        words = [sorted(places[k::3]) for k in range(rng.randint(1, 3))]
        rows.append([w for w in words if w])
        sizes.append(rng.choice([5, 100, 4000]))
    row_of, counts, own, other, times = close_pairs(pa.array(rows, pa.list_(pa.list_(pa.int32()))), 2)
    sums = np.zeros(len(counts))
    for a, b, n in zip(own, other, times):
        left = sizes[row_of[a]] - counts[b] + 1
        sums[a] += n * np.log2(left / (counts[b] + 0.5)) / 4 if left > 0 else 0.0
    assert sums == pytest.approx([x for words, size in zip(rows, sizes) for x in accumulate(words, size)])


def test_the_walk_as_an_sql_function(spark):
    from lexflume.functions.register import register_functions

    register_functions(spark)
    rows = spark.sql("SELECT visited_close(a, b, 2) AS n FROM VALUES (array(1, 5), array(2, 9)), (array(1), array(2, 3)), (CAST(array() AS ARRAY<INT>), array(1)), (CAST(NULL AS ARRAY<INT>), array(1)) t(a, b)")
    assert [r.n for r in rows.collect()] == [1, 3, 0, None]
