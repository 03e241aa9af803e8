"""Main content of pages by template deduction from equivalence classes.

A site writes its pages from a template: the texts around an article are its constant parts, the article fills a slot.

1. Tokens and occurrence vectors. Within a host a token is a line in its role (numbers, the site's own name and a bullet
   in front are slots), the part of a line before a colon, or the first step of a path. Its occurrence vector says on which of the host's articles
   it occurs; crawls of one article count once, so copies of an article don't look like a template. Tokens with the
   same vector form an equivalence class (the vector is kept as a mergeable signature: a count and an XOR of hashes).
2. Valid classes. A class needs three articles and a share of the host's articles: a class of one token LEAST_SHARE, a
   class of several tokens that keep one order on the pages LARGE_SHARE. Chance can't make several lines agree in all
   their articles and their order, so large classes need less support.
3. Nesting. Class A is nested in class B if B is on (nearly) all pages of A and on more pages altogether. The smallest
   such class is A's parent, the number of them its depth, and the order of first occurrences says whether A stands
   before or behind its parent's first token or changes sides. Classes in none are at the root, which is every page.
   All valid classes, nested this way, are the host's template; there are as many per host as fit on a page over their
   least share, however many pages the host has.
4. Templates of templates. Hosts are in turn written from common templates: a token of the templates of two hosts at
   least, and of at least half of the hosts of some size where it occurs at all, is constant everywhere; so small hosts
   are covered. A text that several hosts have but few of them in their template is a heading inside articles. In lines
   that differ by host, words in their context (three in a row, with the line's ends) that are in the templates of two
   hosts are constant and the rest are slots; menus are compared item by item.
5. Slots. What remains between the template's lines is a slot. The page's first slot line is its headline. A slot behind a
   heading that is nearly always followed by title-like lines is a list of other stories; lines that begin, or are
   shaped, like lines whose run mostly stands behind a paragraph end it. All other slots are the main content.

Every statistic is counted over all pages; a page's lines are looked at together in one row, all else is joins and
partial aggregates. A hot host is spread by (host, token).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexflume.functions.arrow import text_slices
from lexflume.session import materialize, maybe_broadcast

LEAST_ARTICLES = 3
LEAST_SHARE, LARGE_SHARE = 0.4, 0.25
ORDERED, CONTAINED = 0.8, 0.9
LEAST_HOSTS = 2
SIZABLE = 5
COVERED = 0.5
ITEMS_COVERED = 0.6
MENU_ITEMS, ITEM_CHARS = 3, 40
HEADING_SHARE = 0.6
INSIDE_SHARE, FIRST_SHARE = 0.5, 0.2
LEARNED_SENT = 500_000

_FURNITURE, _ITEM, _TITLE, _LISTS, _INSIDE, _OUTSIDE, _ITEMS = (1 << k for k in range(7))
_EVERY = _HEADING = 0
_WORD = r"[\p{L}\p{N}\u0001]+"
_SITE = "\u0001"
_BREAK = r"\s*[|·•*/>]\s*|\t|\s{2,}|\s-\s"

_TRIMMED = " \t\r\f\v\u00a0\u200b\ufeff\u2028\u3000"
_NUMBER = re.compile(r"[0-9]+")
_BULLET = re.compile(r"^[-*•·]\s+")
_HOST = re.compile(r"^\w+://([^/:?#]+)")
_SLUG = re.compile(r"/([^/?#]*?)(?:-[0-9]+)?/?(?:[?#].*)?$")
_NAME = re.compile(r"^(?:www\.)?([^.]+)")
_SEPARATORS = re.compile(_BREAK)
_ENDS = tuple(".!?:;\"”»)")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def _lines_of(page: object, url: str | None, host: str | None, text: str) -> Iterator[tuple]:
    url = url or ""
    found = _HOST.match(url)
    host = (host or (found.group(1) if found else "")).lower()
    slug = _SLUG.search(url.lower())
    name = _NAME.match(host)
    site = name.group(1).replace("-", " ").replace("_", " ") if name else ""
    # crawls of one address, whatever number it ends in, are one article
    article = _hash(host, (slug.group(1) if slug else "") or str(page))
    plain = _NUMBER.sub("0", text.lower())
    if len(site) >= 3:
        plain = plain.replace(site, _SITE)
    host_key = _hash(host)
    for at, line in enumerate(plain.split("\n"), 1):
        line = line.strip(_TRIMMED)
        if not line:
            continue
        if line[0] in "-*•·":
            line = _BULLET.sub("", line)
        bits = 0 if line.endswith(_ENDS) else _TITLE
        if _SEPARATORS.search(line):
            bits |= _ITEMS
        yield page, at, host_key, article, bits, line


def _line_batches(kind: pa.DataType):
    kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, 3):
                ids, urls, hosts = (rows.column(k).to_pylist() for k in range(3))
                lines = [x for i, u, h, t in zip(ids, urls, hosts, texts) if t for x in _lines_of(i, u, h, t)]
                columns = zip(*lines) if lines else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page", "line_no", "host", "article", "bits", "text"])

    return run


def page_lines(pages: DataFrame, id_col: str, url_col: str, host_col: str, text_col: str) -> DataFrame:
    """(page, line_no, host, article, bits, text): the lines that aren't blank, in lower case with slots for numbers and the
    site's name, without bullets. bits: title-like (no terminator); with separators of items."""
    rows = pages.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_line_batches(to_arrow_type(rows.schema["page"].dataType)), f"page {_kind(rows)}, line_no int, host long, article long, bits int, text string")


def _kind(rows: DataFrame) -> str:
    return rows.schema["page"].dataType.simpleString()


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _lead(text: Column) -> Column:
    """The key of the part before a colon (the same as that of a line of only this part) or of the first step of a path, else null."""
    step = F.when(F.instr(text, " > ") > 0, _key(F.concat(F.substring_index(text, " > ", 1), F.lit(" >"))))
    return F.coalesce(step, F.when(F.instr(text, ": ") > 0, _key(F.substring_index(text, ": ", 1))))


def _roles(text: Column) -> Column:
    return F.filter(F.array(_key(text), _lead(text)), lambda k: k.isNotNull())


def occurrence_vectors(lines: DataFrame) -> DataFrame:
    """(host, key, articles, vector): every token of a host with its occurrence vector; the row with key 0 counts all articles."""
    seen = lines.select("host", "article", F.explode(F.array_append(_roles(F.col("text")), F.lit(_EVERY).cast("long"))).alias("key")).distinct()
    return seen.groupBy("host", "key").agg(F.count("*").alias("articles"), F.bit_xor("article").alias("vector"))


def _candidates(lines: DataFrame) -> DataFrame:
    """(host, key, cls, size, articles, n): the tokens of the equivalence classes that have the least support of a large class."""
    vectors = materialize(occurrence_vectors(lines).where(F.col("articles") >= 2))
    every = vectors.where(F.col("key") == _EVERY).select("host", F.col("articles").alias("n"))
    tokens = vectors.where((F.col("key") != _EVERY) & (F.col("articles") >= LEAST_ARTICLES)).join(maybe_broadcast(every), "host")
    tokens = tokens.where(F.col("articles") >= LARGE_SHARE * F.col("n"))
    cls = F.xxhash64("vector", "articles").alias("cls")
    alike = W.partitionBy("host", "vector", "articles")
    return materialize(tokens.select("host", "key", cls, F.count("*").over(alike).alias("size"), "articles", "n"))


def _nest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, a, b, sequence, n, ahead) over pages given as lists of (line_no, cls, key): on how many pages classes a and b
    both are and how often a begins first; for a = b the number of pages by the sequence of the class's tokens."""
    n, ahead = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        columns = [*zip(*n)] if n else [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(list(n.values()), pa.int64()), pa.array([ahead[k] for k in n], pa.int64())], ["host", "a", "b", "sequence", "n", "ahead"])

    for batch in batches:
        hosts = batch.column(0).to_pylist()
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        line, cls, key = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for host, a, b in zip(hosts, offsets[:-1], offsets[1:]):
            order = np.argsort(line[a:b], kind="stable") + a
            tokens: dict[int, dict[int, None]] = {}
            for c, k in zip(cls[order].tolist(), key[order].tolist()):
                tokens.setdefault(c, {})[k] = None
            first = list(tokens)
            for at, c in enumerate(first):
                own = tokens[c]
                n[host, c, c, _hash(*map(str, own)) if len(own) > 1 else 0] += 1
                for later in first[at + 1 :]:
                    pair = (host, c, later, 0) if c < later else (host, later, c, 0)
                    n[pair] += 1
                    ahead[pair] += c < later
        if len(n) > 200_000:
            yield counted()
            n, ahead = Counter(), Counter()
    if n:
        yield counted()


def nested_template(lines: DataFrame) -> DataFrame:
    """(host, key, cls, size, articles, n, depth, parent, place): the tokens of every host's template.

    Only valid equivalence classes are in it (see the module's text), each with its depth, its parent class (null at the
    root) and its place by the parent's first token: 'before', 'behind' or 'floating'.
    """
    tokens = _candidates(lines)
    sent = maybe_broadcast(tokens.select("host", "key", "cls"))
    held = lines.select("host", "page", "line_no", F.explode(_roles(F.col("text"))).alias("key")).join(sent, ["host", "key"])
    pages = held.groupBy("host", "page").agg(F.collect_list(F.struct("line_no", "cls", "key")).alias("tokens")).select("host", "tokens")
    counted = materialize(pages.mapInArrow(_nest_batches, "host long, a long, b long, sequence long, n long, ahead long").groupBy("host", "a", "b", "sequence").agg(F.sum("n").alias("n"), F.sum("ahead").alias("ahead")))
    own = counted.where("a = b").groupBy("host", F.col("a").alias("cls")).agg(F.sum("n").alias("pages"), F.max("n").alias("in_order"))
    own = own.join(tokens.select("host", "cls", "size", "articles", F.col("n").alias("all")).distinct(), ["host", "cls"])
    large = (F.col("size") > 1) & (F.col("in_order") >= ORDERED * F.col("pages"))
    valid = maybe_broadcast(materialize(own.where(large | (F.col("articles") >= LEAST_SHARE * F.col("all"))).select("host", "cls", "pages")))
    pairs = counted.where("a <> b").join(valid.withColumnsRenamed({"cls": "a", "pages": "pages_a"}), ["host", "a"]).join(valid.withColumnsRenamed({"cls": "b", "pages": "pages_b"}), ["host", "b"])
    sides = [F.struct(F.col(x).alias("cls"), F.col(y).alias("outer"), F.col(f"pages_{x}").alias("pages"), F.col(f"pages_{y}").alias("outer_pages"), ahead.alias("ahead")) for x, y, ahead in (("a", "b", F.col("ahead")), ("b", "a", F.col("n") - F.col("ahead")))]
    inside = pairs.select("host", "n", F.explode(F.array(*sides)).alias("x")).select("host", "n", "x.*").where((F.col("n") >= CONTAINED * F.col("pages")) & (F.struct("outer_pages", "outer") > F.struct("pages", "cls")))
    side = F.when(F.col("ahead") >= CONTAINED * F.col("n"), "before").when(F.col("ahead") <= (1 - CONTAINED) * F.col("n"), "behind").otherwise("floating")
    nested = inside.groupBy("host", "cls").agg(F.count("*").alias("depth"), F.min_by(F.struct(F.col("outer").alias("parent"), side.alias("place")), F.struct("outer_pages", "outer")).alias("in"))
    rows = tokens.join(valid.select("host", "cls"), ["host", "cls"]).join(nested, ["host", "cls"], "left")
    return rows.select("host", "key", "cls", "size", "articles", "n", F.coalesce("depth", F.lit(0)).alias("depth"), "in.parent", "in.place")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def _contexts(text: Column) -> Column:
    """Hashes of three words in a row, the line's ends counting as words."""
    padded = F.concat(F.array(F.lit("^")), _words(text), F.array(F.lit("$")))
    return F.transform(F.sequence(F.lit(1), F.size(padded) - 2), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(padded, i, 3))))


def _items(text: Column) -> Column:
    return F.array_remove(F.split(text, _BREAK), "")


def _classified(lines: DataFrame) -> DataFrame:
    """(page, line_no, key, first, second, shape, bits) of every line, from the templates of its host and of all hosts."""
    template = materialize(nested_template(lines))
    here = maybe_broadcast(template.select("host", "key"))
    sizable = maybe_broadcast(template.where(F.col("n") >= SIZABLE).select("host").distinct())
    # of the tokens of some host's template: on how many sizable hosts do they occur
    known = maybe_broadcast(materialize(template.groupBy("key").agg(F.count("*").alias("held"))))
    roles = lines.join(sizable, "host", "left_semi").select("host", F.explode(_roles(F.col("text"))).alias("key"))
    spread = roles.join(known.select("key"), "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS)
    common = spread.join(known, "key")
    constant = (F.col("held") >= LEAST_HOSTS) & (F.col("held") >= 0.5 * F.col("hosts"))
    # a text that many hosts have, few of them in their template, is a heading inside articles
    inner = (F.col("hosts") >= 3) & (F.col("held") < 0.5 * F.col("hosts"))
    common = maybe_broadcast(materialize(common.where(constant | inner).select("key", constant.alias("everywhere"), inner.alias("inner"))))

    # values that the templates of several hosts have: contexts of words, menu items, the ends of lines
    keyed = lines.withColumn("key", _key(F.col("text")))
    parts = keyed.join(here, ["host", "key"], "left_semi").join(common.where("inner"), "key", "left_anti").select("host", "text").distinct()
    items = F.filter(_items(F.col("text")), lambda x: F.length(x) <= ITEM_CHARS)
    values = F.concat(_contexts(F.col("text")), F.array(_two(F.col("text"), 2), _two(F.col("text"), -2)), F.when(F.size(items) >= MENU_ITEMS, F.transform(items, lambda x: _key(x))).otherwise(F.array().cast("array<bigint>")))
    shared = parts.select("host", F.explode(values).alias("value")).distinct().groupBy("value").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS)
    shared = maybe_broadcast(materialize(shared.select("value")))

    flag = lambda df, name: df.withColumn(name, F.lit(True))
    mark = keyed.withColumn("lead", _lead(F.col("text"))).join(common, "key", "left")
    lead = common.where("everywhere").select(F.col("key").alias("lead"), F.lit(True).alias("everywhere_lead"))
    mark = mark.join(lead, "lead", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("everywhere", "everywhere_lead", "inner")})
    for small, name, on in ((here, "here", ["host", "key"]), (here.withColumnRenamed("key", "lead"), "here_lead", ["host", "lead"]), (shared.withColumnRenamed("value", "key"), "item", ["key"])):
        mark = _marked(flag(small, name), name, mark, on)

    bit = lambda b: F.col("bits").bitwiseAND(F.lit(b)) > 0
    sure = F.col("everywhere") | F.col("everywhere_lead") | F.col("here_lead") | (F.col("here") & ~F.col("inner"))
    bits = F.col("bits").bitwiseOR(F.when(sure, _FURNITURE).otherwise(0)).bitwiseOR(F.when(F.col("item"), _ITEM).otherwise(0))
    text = F.col("text")
    # lines with numbers are known by their shape, others by their beginning
    numbers = F.contains(text, F.lit("0"))
    begin = [F.when(bit(_TITLE) & ~numbers, F.xxhash64(F.lit(k), F.substring_index(text, " ", k))) for k in (1, 2)]
    name = r"[\p{L}\p{M}'’\u0001-]+"
    shape = F.when(bit(_TITLE) & numbers, F.xxhash64(F.lit(3), F.regexp_replace(text, f"{name}(?: {name})*", "a")))
    plain = mark.select("page", "line_no", "key", begin[0].alias("first"), begin[1].alias("second"), shape.alias("shape"), bits.alias("bits"))

    # the open lines whose first or last words are a template's, or that are made of items, are looked at closely
    open_ = mark.where(~(F.col("everywhere") | F.col("everywhere_lead") | F.col("here") | F.col("here_lead"))).select("page", "line_no", "bits", "text", _two(text, 2).alias("begin"), _two(text, -2).alias("finish"))
    open_ = _marked(flag(shared.withColumnRenamed("value", "begin"), "f"), "f", open_, ["begin"])
    open_ = _marked(flag(shared.withColumnRenamed("value", "finish"), "l"), "l", open_, ["finish"])
    nothing = F.array().cast("array<bigint>")
    found = _items(text)
    close = open_.where(F.col("f") | F.col("l") | bit(_ITEMS)).select(
        "page", "line_no", "bits",
        F.explode(F.concat(
            F.transform(F.when(F.col("f") | F.col("l"), _contexts(text)).otherwise(nothing), lambda v: F.struct(v.alias("value"), F.lit(False).alias("item"), F.lit(False).alias("step"))),
            F.transform(F.when(bit(_ITEMS), found).otherwise(F.array().cast("array<string>")), lambda v, i: F.struct(_key(v).alias("value"), F.lit(True).alias("item"), (i == 0).alias("step"))),
        )).alias("x"),
    ).select("page", "line_no", "bits", "x.*")
    share = lambda of: F.avg(F.when(of, F.col("hit").cast("int")))
    close = _marked(flag(shared, "hit"), "hit", close, ["value"]).groupBy("page", "line_no").agg(
        share(~F.col("item")).alias("covered"), F.count_if(~F.col("item")).alias("words"), share(F.col("item")).alias("menu"), F.count_if(F.col("item")).alias("items"),
        share(F.col("step")).alias("path"), F.first("bits").alias("bits"),
    )
    # one or two words are compared as items, not by context; a path begins with an item of the template's menus and ends anywhere
    sentence = (F.col("covered") >= COVERED) & (F.col("words") >= 3)
    menu = (F.col("items") > 1) & ((F.col("menu") >= ITEMS_COVERED) | ((F.col("path") == 1) & bit(_TITLE)))
    more = close.where(sentence | menu).select("page", "line_no", F.lit(_FURNITURE).alias("more"))
    return plain.join(more, ["page", "line_no"], "left").withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0)))).drop("more")


def _two(text: Column, n: int) -> Column:
    """The key of the first two words of a line, or of the last two."""
    return F.xxhash64(F.lit(n), F.substring_index(F.rtrim(text, F.lit(".!?,;:")), " ", n))


def _marked(small: DataFrame, name: str, rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(small, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, order, bits) of each page of a batch: its lines' places among the batch's in line order, with menu items in a run taken as furniture."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    line, bits = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 5))
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        order = np.argsort(line[a:b], kind="stable") + a
        own = bits[order]
        item = (own & _ITEM) > 0
        beside = np.zeros(len(own), bool)
        beside[1:] |= item[:-1]
        beside[:-1] |= item[1:]
        own[item & beside] |= _FURNITURE
        yield row, order, own


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lines of a batch, and their beginnings and shapes (0: none) as three columns."""
    values = batch.column(1).values
    key, *begins = (values.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(1, 5))
    return key, np.column_stack(begins)


def _counted(n: Counter, hits: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int32()), pa.array([n[k] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.int64())], ["key", "kind", "n", "hits"])


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, n, hits): for furniture lines before a slot (kind 0), how often it begins with a title-like line; for the
    first words (1), first two words (2) and shapes (3) of title-like lines, how often their run stands behind furniture.
    The slot of the page's headline, its first, says nothing about either."""
    n, hits = Counter(), Counter()
    for batch in batches:
        key, begin = _keys_of(batch)
        for _, order, bits in _pages_of(batch):
            furniture, title = (bits & _FURNITURE) > 0, (bits & _TITLE) > 0
            slot = np.flatnonzero(~furniture)
            if not len(slot):
                continue
            ahead = np.flatnonzero(furniture[:-1] & ~furniture[1:])
            ahead = ahead[ahead + 1 > slot[0]]
            keys = key[order]
            n.update((k, _HEADING) for k in keys[ahead].tolist())
            hits.update((k, _HEADING) for k in keys[ahead[title[ahead + 1]]].tolist())
            places = np.arange(len(bits))
            open_ = title & ~furniture
            before = np.maximum.accumulate(np.where(open_, -1, places))
            of = np.flatnonzero(open_ & (before > slot[0]))
            behind = furniture[before[of]]
            own = begin[order]
            for column in range(own.shape[1]):
                values = own[of, column]
                n.update((k, column + 1) for k in values[values != 0].tolist())
                hits.update((k, column + 1) for k in values[behind & (values != 0)].tolist())
        if len(n) > 200_000:
            yield _counted(n, hits)
            n, hits = Counter(), Counter()
    if n:
        yield _counted(n, hits)


def _held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    if not len(among):
        return np.zeros(values.shape, bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _furniture_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headings, inside, outside = sent.value
        for batch in batches:
            key, begin = _keys_of(batch)
            line = batch.column(1).values.field(0).to_numpy(zero_copy_only=False)
            heads, inner = _held(key, headings), _held(begin, inside)
            inner = inner[:, 1] | inner[:, 2] | (inner[:, 0] & ~_held(begin[:, 1], outside))
            rows, lines = [], []
            for row, order, bits in _pages_of(batch):
                listed, headline = False, False
                lists = heads[order] | ((bits & _LISTS) > 0)
                article = inner[order] | ((bits & _INSIDE) > 0) | ((bits & _TITLE) == 0)
                for at, b, starts, ends in zip(line[order].tolist(), bits.tolist(), lists.tolist(), article.tolist()):
                    if b & _FURNITURE:
                        listed = listed or starts
                    else:
                        listed = listed and headline and not ends
                        headline = True
                    if listed or b & _FURNITURE:
                        rows.append(row)
                        lines.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int64())], ["page", "line_no"])

    return run


def furniture_lines(pages: DataFrame, id_col: str, url_col: str, host_col: str, text_col: str) -> DataFrame:
    """(page, line_no): the lines of each page that belong to its site's template or to lists of other stories, not to the main content.

    Lines are split at line feed and numbered from 1, blank ones included; blank lines never come out. Null, empty
    and blank texts have no lines. Pages without a host take it from the URL; without a URL every page is an article
    of its own. Rows with a null id are ignored; repeated rows of a page give the lines once; ids keep their type. Empty
    tables give an empty result. Other columns aren't read.
    """
    lines = materialize(page_lines(pages, id_col, url_col, host_col, text_col))
    by_page = materialize(_by_page(_classified(lines)))
    counted = by_page.mapInArrow(_neighbour_batches, "key long, kind int, n long, hits long").groupBy("key", "kind").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    kinds, share = F.col("kind"), F.col("hits") / F.col("n")
    # a first word alone ends a list only where it hardly ever stands in one
    heading, inside = (kinds == _HEADING) & (share >= HEADING_SHARE), (kinds > 0) & (share < F.when(kinds == 1, FIRST_SHARE).otherwise(INSIDE_SHARE))
    said = F.when(heading, _LISTS).when(inside, _INSIDE).when(kinds == 2, _OUTSIDE)
    learned = materialize(counted.where(F.col("n") >= LEAST_ARTICLES).select("key", said.alias("bit"), "kind").where("bit IS NOT NULL"))
    if learned.limit(LEARNED_SENT + 1).count() <= LEARNED_SENT:
        rows = learned.select("key", "bit").toArrow()
        keys, of = rows.column("key").to_numpy(), rows.column("bit").to_numpy()
        sets = tuple(np.sort(keys[of == bit]) for bit in (_LISTS, _INSIDE, _OUTSIDE))
    else:
        sets = (np.zeros(0, np.int64),) * 3
        open_ = by_page.select("page", F.inline("lines"))
        for kind, column in enumerate(("key", "first", "second", "shape")):
            open_ = open_.join(learned.where(kinds == kind).select(F.col("key").alias(column), F.col("bit").alias(f"by_{column}")), column, "left")
        by = {c: F.coalesce(f"by_{c}", F.lit(0)) for c in ("key", "first", "second", "shape")}
        ends = (by["second"] == _INSIDE) | (by["shape"] == _INSIDE) | ((by["first"] == _INSIDE) & (by["second"] != _OUTSIDE))
        by_page = _by_page(open_.withColumn("bits", F.col("bits").bitwiseOR(by["key"]).bitwiseOR(F.when(ends, _INSIDE).otherwise(0))))
    sent = pages.sparkSession.sparkContext.broadcast(sets)
    return by_page.mapInArrow(_furniture_batches(sent), f"page {_kind(lines)}, line_no long").distinct()


def _by_page(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page").agg(F.collect_list(F.struct("line_no", "key", "first", "second", "shape", "bits")).alias("lines"))


def main_content(pages: DataFrame, id_col: str, url_col: str, host_col: str, text_col: str) -> DataFrame:
    """(page, content): the text of each page without its furniture lines; pages without main content don't come out."""
    furniture = furniture_lines(pages, id_col, url_col, host_col, text_col)
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("page"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    rows = rows.select("page", (F.col("at") + 1).cast("long").alias("line_no"), "line").where(F.trim("line") != "").distinct()
    kept = rows.join(furniture, ["page", "line_no"], "left_anti").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return kept.select("page", F.array_join(F.col("lines.line"), "\n").alias("content"))
