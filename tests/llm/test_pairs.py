"""Near-duplicates, leakage and furniture against brute force on small fixtures."""

import random
import re

import numpy as np
import pytest

from lexflume.functions.words import words
from lexflume.llm import boilerplate, leakage, near_dup

WORDS = [f"w{i}" for i in range(400)]
NAMES = ["".join("bdfgklmnprstvz"[i // k % 14] + "aeiou"[i // k % 5] for k in (1, 7, 61)) for i in range(400)]


def _edited(rng, text, share):
    out = []
    for w in text.split():
        r = rng.random()
        out += [rng.choice(WORDS)] if r < share / 2 else [] if r < share * 0.75 else [w]
    return " ".join(out)


def _brute(pages, size, least):
    sets = {}
    for i, t in pages:
        w = words(t or "")
        if i is not None and len(w) >= size:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    made = []
    for k in range(30):
        text = " ".join(rng.choice(WORDS) for _ in range(150))
        made += [text, _edited(rng, text, 0.06), _edited(rng, text, 0.1)]
    made += [made[0], made[0].replace(" ", "  ").upper(), "", "  \n ", "two words", None, "ñandú über alles " * 3, "w1 " * 20_000]
    return [(i * 7 + 1, t) for i, t in enumerate(made)]


def test_near_duplicates_equal_brute_force(spark, pages):
    docs = spark.createDataFrame(pages, "page_id long, content string")
    links, members = near_dup.near_duplicates(docs, "page_id", "content", 3, 0.5)
    found = {tuple(r) for r in near_dup.expand_pairs(links, members).collect()}
    wanted = _brute(pages, 3, 0.5)
    clear = {p for p, j in wanted.items() if j >= 0.55}
    assert len(clear) > 50
    assert found <= set(wanted)
    assert len(clear - found) <= 0.02 * len(clear)


def test_near_duplicates_edges(spark, pages):
    empty = spark.createDataFrame([], "page_id long, content string")
    links, members = near_dup.near_duplicates(empty, "page_id", "content")
    assert links.count() == 0 and members.count() == 0
    doubled = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "page_id long, content string").selectExpr("*", "'x' AS id", "1 AS a", "2 AS anchor", "'y' AS text")
    links, members = near_dup.near_duplicates(doubled, "page_id", "content")
    assert {tuple(r) for r in near_dup.expand_pairs(links, members).collect()} == {(1, 2)}


def test_hot_class_of_copies_gives_one_class(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(500)], "id long, text string")
    links, members = near_dup.near_duplicates(docs, "id", "text")
    assert links.count() == 0
    assert members.groupBy("class_id").count().collect()[0].asDict() == {"class_id": 0, "count": 500}


def test_anchor_code_covers_and_meets():
    near = near_dup._NEAR
    for a in range(128):
        assert bin(a ^ int(near[a][0])).count("1") <= near_dup.RADIUS
        for bit in range(7):
            b = a ^ (1 << bit)
            assert int(near[a][0]) in near[b] and int(near[b][0]) in near[a]


def test_recall_is_what_the_module_promises():
    assert near_dup.recall(0.5) > 0.99
    assert near_dup.recall(0.55, 0.5) > 0.99
    assert near_dup.recall(0.8) > 0.99


def test_recall_on_made_pairs_near_the_threshold(spark):
    """Two hundred pairs of similarities between 0.50 and 0.55, each of its own words."""
    rng = random.Random(2)
    rows = []
    while len(rows) < 400:
        own = [f"x{len(rows)}y{k}" for k in range(90)]
        other = list(own)
        for at in rng.sample(range(90), rng.randint(8, 14)):
            other[at] = f"z{len(rows)}y{at}"
        sets = [{tuple(w[k : k + 3]) for k in range(88)} for w in (own, other)]
        if 0.5 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.55:
            rows += [(f"d{len(rows):03}", " ".join(own)), (f"d{len(rows) + 1:03}", " ".join(other))]
    links, _ = near_dup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.5)
    assert links.count() >= 0.98 * 200


def test_hot_anchors_in_blocks_give_the_same(spark, pages, monkeypatch):
    docs = spark.createDataFrame(pages, "page_id long, content string")
    one = {tuple(r)[:2] for r in near_dup.near_duplicates(docs, "page_id", "content", 3, 0.5)[0].collect()}
    monkeypatch.setattr(near_dup, "SPLIT", 1)
    assert {tuple(r)[:2] for r in near_dup.near_duplicates(docs, "page_id", "content", 3, 0.5)[0].collect()} == one


def test_classes_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five six seven" if i % 3 else f"one two three four five six {i}") for i in range(60)], "id long, text string")
    wanted = {tuple(r) for r in near_dup.near_duplicates(docs, "id", "text")[1].collect()}
    monkeypatch.setattr(near_dup, "maybe_broadcast", lambda df: df)
    assert {tuple(r) for r in near_dup.near_duplicates(docs, "id", "text")[1].collect()} == wanted and len(wanted) == 60



def _naive_leaks(docs, items, least):
    out = set()
    for d, text in docs:
        w = words(text or "")
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for i, item in items:
            v = words(item or "")
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(20)]
    items.append((20, items[0][1] + " tail " + items[1][1]))
    docs = []
    for d in range(200):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(20))]
        if d % 3 == 0:
            own = rng.choice(items)[1].split()
            at = rng.randint(0, max(0, len(own) - 12))
            parts.append(" ".join(own[at : at + rng.randint(10, 20)]).upper() + "!")
        docs.append((d, ", ".join(parts)))
    docs += [(900, None), (901, ""), (902, items[2][1] * 2), (None, items[0][1]), (903, items[0][1]), (903, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "'z' AS words")
    found = leakage.find_leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 12)
    wanted = {x for x in _naive_leaks(docs, items, 12) if x[0] is not None}
    assert {(r.doc, r.item) for r in found.collect()} == wanted and len(wanted) > 10
    assert {r.words for r in found.where("doc = 903 AND item = 0").collect()} == {len(items[0][1].split())}
    clean = leakage.without_leaks(df, "doc_id", found)
    assert clean.where("doc_id = 903").count() == 0 and clean.where("doc_id = 900").count() == 1


def test_leaks_in_blocks_and_empty(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"a{i}b{k}" for k in range(15))) for i in range(9)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 AS doc_id", "text")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 200)
    found = leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text")
    assert {(r.doc, r.item) for r in found.collect()} == {(i + 100, i) for i in range(9)}
    none = leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text")
    assert none.count() == 0
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_repetitive_texts_and_text_ids(spark, monkeypatch):
    items = spark.createDataFrame([("i", "again " * 30), ("j", " ".join(f"b{k}" for k in range(20)))], "item_id string, text string")
    docs = spark.createDataFrame([("d", "again " * 200), ("e", " ".join(f"b{k}" for k in range(3, 18))), ("f", "again " * 11)], "doc_id string, text string")
    rows = lambda: {tuple(r) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    whole = rows()
    monkeypatch.setattr(leakage, "HITS_AT_ONCE", 50)
    assert rows() == whole and {r[:2] for r in whole} == {("d", "i"), ("e", "j")} and max(r[2] for r in whole) == 30


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 300).astype(np.int32)
    order = leakage.suffix_array(codes, 64)
    suffixes = [tuple(codes[i : i + 64]) for i in order]
    assert suffixes == sorted(suffixes)


def _site(rng, host, n, menu, notices):
    out = []
    for k in range(n):
        title = f"{rng.choice(['Quiet', 'Loud', 'Old'])} {rng.choice(NAMES)} {rng.choice(NAMES)} opens near {rng.choice(NAMES)}"
        slug = re.sub("[^a-z0-9]+", "-", title.lower())
        body = [f"The {rng.choice(NAMES)} said {' '.join(rng.choice(NAMES) for _ in range(12))}." for _ in range(5)]
        lines = [menu, "", title, *body[:3], "Read next", f"Another {rng.choice(NAMES)} {rng.choice(NAMES)} returns", *body[3:], *notices]
        furniture = [1, 7, 8, *range(len(lines) - len(notices) + 1, len(lines) + 1)]
        out.append((f"http://{host}/news/{slug}-{k}", host, lines, furniture))
    return out


def test_furniture_on_a_made_site(spark):
    rng = random.Random(8)
    pages = _site(rng, "alpha-post.example", 12, "Home | News | Sport | Radio", ["Copyright 2024 Alpha post", "We use small files to count visits."])
    pages += _site(rng, "beta-news.example", 12, "News | Home | Radio | Sport", ["Copyright 2023 Beta news", "We use small files to count visits."])
    pages += _site(rng, "gamma.example", 1, "Radio | Sport | Home", ["Copyright 2025 Gamma", "We use small files to count visits."])
    table = [(i, url, host, "\r\n".join(lines) if i % 2 else "\n".join(lines)) for i, (url, host, lines, _) in enumerate(pages)]
    table += [(500, None, None, "Only a line."), (501, "x", "h", None), (502, "x", "h", ""), (503, "x", "h", " \n "), (None, "x", "h", "Home | News")]
    df = spark.createDataFrame(table, "page_id long, url string, host string, content string").selectExpr("*", "1 AS page", "2 AS line_no")
    found = {tuple(r) for r in boilerplate.furniture_lines(df, "page_id", "url", "host", "content").collect()}
    wanted = {(i, n) for i, (_, _, _, furniture) in enumerate(pages) for n in furniture}
    assert found == wanted
    content = {r.page: r.content for r in boilerplate.main_content(df, "page_id", "url", "host", "content").collect()}
    assert content[500] == "Only a line." and "Home" not in content[0] and set(content) == {*range(len(pages)), 500}
    classes = boilerplate.nested_template(boilerplate.page_lines(df, "page_id", "url", "host", "content"))
    assert classes.where("depth = 0").count() >= 2


def test_a_class_of_several_lines_needs_less_support(spark):
    """Two lines that always stand together, in one order, on three of ten pages are a template's; a single line, or two in changing order, are not."""
    rng = random.Random(11)
    pages = []
    for k in range(10):
        body = [f"The {rng.choice(NAMES)} said {' '.join(rng.choice(NAMES) for _ in range(12))}." for _ in range(4)]
        block = ["Win a lamp today.", "Send your name to our desk."] if k in (1, 4, 8) else []
        moved = ["Bread is sold here.", "Cheese is sold there."][:: -1 if k % 4 == 0 else 1] if k in (0, 2, 4) else []
        lonely = ["A quiet hour."] if k in (3, 5, 6) else []
        pages.append((k, f"http://one.example/story-{NAMES[k]}", "one.example", "\n".join(["Home | News | Radio", f"{NAMES[k]} opens", body[0], *lonely, *body[1:3], *moved[:1], body[3], *moved[1:], *block, "All rights reserved by One."])))
    df = spark.createDataFrame(pages, "page_id long, url string, host string, content string")
    lines = {(i, n): t for i, _, _, text in pages for n, t in enumerate(text.split("\n"), 1)}
    found = {lines[tuple(r)] for r in boilerplate.furniture_lines(df, "page_id", "url", "host", "content").collect()}
    assert found == {"Home | News | Radio", "All rights reserved by One.", "Win a lamp today.", "Send your name to our desk."}
    template = {(r.size, r.depth) for r in boilerplate.nested_template(boilerplate.page_lines(df, "page_id", "url", "host", "content")).collect()}
    assert (2, 0) in template and any(size == 2 and depth > 0 for size, depth in template)


def test_ids_of_text_stay(spark):
    df = spark.createDataFrame([(f"p{k}", f"http://h.example/{NAMES[k]}", "h.example", f"Menu of the house\n{NAMES[k]} opened in {NAMES[k + 9]}.") for k in range(5)], "page_id string, url string, host string, content string")
    assert {tuple(r) for r in boilerplate.furniture_lines(df, "page_id", "url", "host", "content").collect()} == {(f"p{k}", 1) for k in range(5)}


def test_furniture_without_the_learned_sets_sent(spark, monkeypatch):
    rng = random.Random(9)
    pages = _site(rng, "alpha-post.example", 8, "Home | News | Sport | Radio", ["Copyright 2024 Alpha post"]) + _site(rng, "beta.example", 8, "News | Home | Radio", ["Copyright 2024 Beta"])
    df = spark.createDataFrame([(i, u, h, "\n".join(lines)) for i, (u, h, lines, _) in enumerate(pages)], "page_id long, url string, host string, content string")
    args = (df, "page_id", "url", "host", "content")
    one = {tuple(r) for r in boilerplate.furniture_lines(*args).collect()}
    monkeypatch.setattr(boilerplate, "LEARNED_SENT", 0)
    assert {tuple(r) for r in boilerplate.furniture_lines(*args).collect()} == one
    assert boilerplate.furniture_lines(df.limit(0), "page_id", "url", "host", "content").count() == 0
