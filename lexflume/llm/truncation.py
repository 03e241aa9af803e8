"""Records cut off by field limits or transfers, by a structural completeness check.

A stack automaton reads each text from its beginning to its end. It pushes openers (brackets, quotes of all kinds, straight
ones too, markup elements), pops them at their closers, and knows whether the text ends inside a tag, an entity, an
escape or a broken character. A text that ends inside one of these is cut; so is one that leaves an opener on the stack,
unless its source does so as a rule (a baseline per source and kind of opener). Texts that are closed and end with a
terminator are whole; a table row shorter than those before, and a number or a quotation without the rest of its sentence,
are cut. The rest are closed but end without a terminator or with a mark of omission. Where a source hardly ever
sets terminators, the lack of one says nothing; elsewhere the collection decides, by counts over all records:

* endings that recur (sign-offs, end marks, link lines, names behind a sign-off, table rows of the usual shape) are whole,
  unless the last lines of other texts go on after the same words;
* a line behind a table row that begins a first cell of some table is a row cut within that cell;
* an omission mark is a trailing-off thought if the same words stand before one in the middle of other texts;
* a source whose longest length, in characters or bytes, is hit again and again has a limit there: an open end at the
  limit is a cut whatever else it looks like, except a recurring ending;
* a text of one line with no sentence end in it is a headline if its last word also ends sentences, lines or other texts,
  and not if it hardly ever does for the many times it stands, or longer words begin with it, in texts, or is only known as
  such a beginning; where the collection says neither, it is one if it has no more words than the mean sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.functions.arrow import text_slices
from lexflume.session import materialize, maybe_broadcast

RECURS = 3
STYLE_SHARE, STYLE_TEXTS = 0.5, 20
UNENDED_SHARE = 0.95
ENDING_SHARE, OFTEN = 0.005, 200
COMPLETE_SHARE, NAMED_SHARE = 0.5, 0.8
LIMIT_SHARE, LIMIT_TEXTS = 0.02, 4
WHOLE, CUT, OMISSION, OPEN = 0, 1, 2, 3

_TERMINATORS = ".!?。！？।؟۔…‽｡"
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}
_CLOSERS = ")]}»”“\"'’"
_OPENER = {closer: opener for opener, closer in _PAIRS.items()}
#: Elements without content, and those whose end may be left out.
_VOID = frozenset("area base br col embed hr img input li link meta option p source td th tr track wbr".split())
_SIGN = re.compile(r"[:;=]-?[()\[\]](?!\w)|[()\[\]{}«»“”„\"]|<!--|-->|</?[a-zA-Z][^<>]*>?|&#?\w*;?|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2}|.)?|%(?:[0-9a-fA-F]{1,2})?|\ufffd", re.S)
_UNFINISHED = re.compile(r"<[^>]{0,200}|&#?\w{1,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9a-fA-F]?|\ufffd", re.S)
_SENTENCE_END = re.compile(r"[.!?。！？]\s")
_INVISIBLE = "​‌‍⁠﻿­‎‏"
_OMISSION = re.compile(r"\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{3,}|…)\s*\)|\.{3,}|…)$")
_INNER_OMISSION = re.compile(r"([^.!?…\n]{3,80})(?:\.{3,}|…)(?=\s*\S)")
_SMILEY = re.compile(r"\s*[:;=]-?[)D(P]$")
_HASHTAG = re.compile(r"(?:\s+#\w+)+$")
_ABBREVIATED = re.compile(r"(?:^|[.!?]\s+)(?:\S+\s+){0,2}\d+\s[ap]\.(?:m\.)?$")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def automaton(text: str) -> tuple[list[str], str]:
    """(stack, inside): what the text leaves open, outermost first (characters, or names of elements), and the unfinished tag,
    entity, escape or broken character that it ends in, or an empty string.

    A closer pops its opener and what was opened inside; a closer without an opener, a quote behind a number (inches) and
    emoticons are none. Elements that need no end tag aren't pushed.
    """
    stack: list[str] = []
    inside = ""
    for found in _SIGN.finditer(text):
        sign = found.group()
        c = sign[0]
        if found.end() == len(text) and c in "<&\\%\ufffd" and sign[-1] not in ">;" and _UNFINISHED.fullmatch(sign) and not (c == "%" and len(sign) == 1):
            inside = sign
        elif sign == "-->":
            _pop(stack, "<!--")
        elif c == "<":
            name = sign.strip("</>").split(maxsplit=1)[0].lower() if sign != "<!--" else sign
            if sign.startswith("</"):
                _pop(stack, name)
            elif sign[-1] == ">" and not sign.endswith("/>") and name not in _VOID or sign == "<!--":
                stack.append(name)
        elif len(sign) > 1 or c in "&\\%\ufffd":
            continue
        elif c == '"':
            if not _pop(stack, c) and not text[max(0, found.start() - 1) : found.start()].isdigit():
                stack.append(c)
        elif not (c in _OPENER and _pop(stack, _OPENER[c])) and c in _PAIRS:
            stack.append(c)
    return stack, inside


def _pop(stack: list[str], opener: str) -> bool:
    """Close the innermost such opener with all that was opened inside; False if there is none."""
    for at in range(len(stack) - 1, -1, -1):
        if stack[at] == opener:
            del stack[at:]
            return True
    return False


def _plain(line: str) -> str:
    return re.sub(r"\d+", "0", line.strip().lower())


def _shape(field: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "0", field.strip()))


def _lines(text: str) -> list[str]:
    return [x for x in text.rstrip().rstrip(_INVISIBLE).rstrip().split("\n") if x.strip()]


def _first_word(line: str) -> str:
    return next(iter(re.findall(r"\w+", line.lower())), line)


def _cells(row: str) -> list[str]:
    return row.split(" | ") if row.count(" | ") > 1 else []


def tables(text: str) -> tuple[list[str], str | None]:
    """(first cells of the rows of three and more cells before the last line, the last line if it is one cell behind such a row)."""
    if " | " not in text:
        return [], None
    lines = _lines(text)
    cells = {c[0].strip() for c in map(_cells, lines[:-1]) if c} - {""}
    behind = len(lines) > 1 and _cells(lines[-2]) and " | " not in lines[-1].strip()
    return sorted(cells), (lines[-1].strip(" |") or None) if behind else None


def _is_picture(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Mn", "Me") or c in "‍️"


def _body(text: str) -> str:
    return text.rstrip().rstrip(_INVISIBLE).rstrip()


def ending(text: str) -> tuple[int, list[int]]:
    """(verdict, keys) of a text on its own: what the automaton finds unclosed or unfinished is CUT, else its end decides (`by_end`)."""
    stack, inside = automaton(_body(text))
    return (CUT, []) if stack or inside else by_end(text)


def by_end(text: str) -> tuple[int, list[int]]:
    """(verdict, keys) by the end alone: WHOLE, CUT, OMISSION with [key of the words before the mark], or OPEN with the keys of the ending:
    [line, line before, lead, last word, first word, first word and length, shape of a table row, words of the line, lines of the text,
    whether it is one line without a sentence end]."""
    body = _body(text)
    if not body:
        return WHOLE, []
    mark = _OMISSION.search(body[-12:])
    if mark and mark.group().strip():
        before = body[: len(body) - len(mark.group())]
        phrase = re.split(r"[.!?…\n]", before[-100:])[-1]
        return OMISSION, [_hash(_plain(phrase))]
    before = body
    while before and _is_picture(before[-1]):
        before = before[:-1].rstrip()
    if before != body and (not before or before[-1] in _TERMINATORS or before[-1] in _CLOSERS):
        return WHOLE, []
    for tail in (_SMILEY, _HASHTAG):
        found = tail.search(body[-80:])
        if found:
            before = body[: len(body) - len(found.group())].rstrip()
            if before and before[-1] in _TERMINATORS:
                return WHOLE, []
    last = body[-1]
    if last in _TERMINATORS:
        if re.search(r"\d\.$", body) and re.search(r"\d\.\d", body) or _ABBREVIATED.search(body[-60:]):
            return CUT, []
        return WHOLE, []
    lines = _lines(body)
    line = lines[-1].strip()
    if last in ")]}":
        opened = line.rfind({")": "(", "]": "[", "}": "{"}[last])
        inside = line[opened + 1 : -1].rstrip()
        ahead = line[: max(opened, 0)].rstrip()
        if opened >= 0 and (not ahead or ahead[-1] in _TERMINATORS or ahead[-1] in "\"”»“" or (inside and inside[-1] in _TERMINATORS)):
            return WHOLE, []
        return CUT, []
    if last in "\"”»“’'" and len(body) > 1:
        said = body[:-1].rstrip()
        if said and said[-1] in _TERMINATORS:
            return WHOLE, []
        if last != "'" and last != "’":
            return CUT, []
    if " | " in line or (len(lines) > 1 and " | " in lines[-2]):
        rows = [x.split(" | ") for x in lines[:-1] if " | " in x]
        own = line.split(" | ")
        if rows and len(rows[-1]) > 2:
            alike = [r for r in rows if len(r) == len(own)]
            if len(own) > 1:
                return (WHOLE if alike and _shape(own[-1]) in {_shape(r[-1]) for r in alike} else CUT), []
    words = re.findall(r"\w+", line.lower())
    first = _first_word(line)
    lead = line.split(": ", 1)[0] if ": " in line else ""
    row = _hash(str(line.count(" | ")), _shape(line.split(" | ")[-1])) if " | " in line and re.search(r"\d", line.split(" | ")[-1]) else 0
    return OPEN, [
        _hash(_plain(line)), _hash(_plain(lines[-2])) if len(lines) > 1 and not _cells(lines[-2]) else 0, _hash(_plain(lead)) if lead else 0, _hash(lead.lower(), words[-1] if words else ""),
        _hash(first), _hash(first, str(len(words))), row, len(words), len(lines), int(len(lines) == 1 and not _SENTENCE_END.search(line)),
    ]


_FEATURES = "source string, unclosed string, chars int, bytes int, copy long, verdict int, keys array<long>, inner array<long>, cells array<string>, stub string, tail string, begins long"


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, 1):
            verdicts, keys, inner, sizes, cells, stubs, tails, begins, unclosed = [], [], [], [], [], [], [], [], []
            for text in texts:
                stack, inside = automaton(_body(text))
                unclosed.append(stack[0] if stack else None)
                verdict, own = (CUT, []) if inside else by_end(text)
                verdicts.append(verdict)
                keys.append(own)
                inner.append([_hash(_plain(m)) for m in _INNER_OMISSION.findall(text)] if "..." in text or "…" in text else [])
                firsts, stub = tables(text)
                cells.append(firsts)
                stubs.append(stub)
                lines = _lines(text)
                tails.append(_plain(lines[-1]) if lines else "")
                begins.append(_hash(_first_word(lines[-1].strip())) if len(lines) > 1 else 0)
                raw = text.encode()
                sizes.append((len(text), len(raw), xxhash.xxh64_intdigest(raw) - (1 << 63)))
            chars, size, copy = zip(*sizes) if sizes else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(unclosed, pa.string()), pa.array(chars, pa.int32()), pa.array(size, pa.int32()), pa.array(copy, pa.int64()), pa.array(verdicts, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(inner, pa.list_(pa.int64())),
                 pa.array(cells, pa.list_(pa.string())), pa.array(stubs, pa.string()), pa.array(tails, pa.string()), pa.array(begins, pa.int64())],
                ["doc", "source", "unclosed", "chars", "bytes", "copy", "verdict", "keys", "inner", "cells", "stub", "tail", "begins"],
            )


def source_limits(features: DataFrame, measure: str) -> DataFrame:
    """(source, limit): the longest length of a source, where several of its distinct texts have just that length."""
    lengths = features.groupBy("source", measure, "copy").count().groupBy("source", measure).agg(F.count("*").alias("texts"))
    own = W.partitionBy("source")
    top = lengths.withColumn("longest", F.max(measure).over(own)).withColumn("all", F.sum("texts").over(own)).where(F.col(measure) == F.col("longest"))
    return top.where((F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") >= LIMIT_SHARE * F.col("all"))).select("source", F.col(measure).alias("limit"))


def _recurring(ends: DataFrame, key: str, least: int = RECURS) -> DataFrame:
    """(key, texts): keys other than 0 that end at least `least` distinct texts."""
    return ends.where(F.col(key) != 0).select(F.col(key).alias("key"), "copy").distinct().groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)


def _prefixes(texts: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of `texts` once for each length in `wanted` (size) that `column` reaches, with the hash of that prefix as `key`."""
    sizes = maybe_broadcast(materialize(wanted.select("size").distinct()))
    return texts.join(sizes, F.length(column) >= F.col("size")).withColumn("key", F.xxhash64(F.substring(F.col(column), F.lit(1), F.col("size"))))


def _complete(ends: DataFrame, features: DataFrame) -> DataFrame:
    """(key): recurring last lines at which at least COMPLETE_SHARE of the texts end whose last line begins with them."""
    ending_at = ends.groupBy(F.col("line").alias("own")).agg(F.count_distinct("copy").alias("texts"), F.min(F.xxhash64("tail")).alias("key"), F.min(F.length("tail")).alias("size")).where(F.col("texts") >= RECURS)
    ending_at = materialize(ending_at)
    longer = _prefixes(features.select("tail", "copy").distinct(), "tail", ending_at).where(F.length("tail") > F.col("size"))
    more = longer.join(maybe_broadcast(ending_at.select("key")), "key", "left_semi").groupBy("key").agg(F.count("*").alias("more"))
    kept = ending_at.join(more, "key", "left").where(F.col("texts") >= COMPLETE_SHARE * (F.col("texts") + F.coalesce("more", F.lit(0))))
    return kept.select(F.col("own").alias("key"))


_FINAL = r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$"
#: A word inside a text, with what shows that a sentence or a line ends behind it.
_INNER_WORD = r"[\p{L}\p{N}]+(?:[.!?。！？]+(?=\s)|[^\S\n]*\n)?(?=[\s\S])"


def _final_words(ends: DataFrame, rows: DataFrame, texts: int) -> tuple[DataFrame, DataFrame, float]:
    """(key) of the last words of single lines that end headlines of any length, (key) of those of which nothing is known, and
    the mean number of words to a sentence (see the module's text). The words of all texts are counted, partially before
    the shuffle."""
    last = ends.where("single = 1").select(F.regexp_extract("tail", _FINAL, 1).alias("word"), "copy").where("word <> ''").distinct()
    last = materialize(last.groupBy("word").agg((F.count("*") - 1).alias("others")).select("word", "others", F.xxhash64("word").alias("key"), F.length("word").alias("size")))
    tokens = rows.where("text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.regexp_replace(F.lower("text"), r"\d+", "0"), F.lit(_INNER_WORD), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    word = F.regexp_extract("token", r"^[\p{L}\p{N}]+", 0)
    words = tokens.select(word.alias("word"), "n", F.when(F.length(word) < F.length("token"), F.col("n")).otherwise(0).alias("ended")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    words = materialize(words)
    longer = _prefixes(words, "word", last).where(F.length("word") > F.col("size")).join(maybe_broadcast(last.select("key")), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("longer"))
    known = last.join(words, "word", "left").join(longer, "key", "left")
    known = known.na.fill(0, ["n", "ended", "longer"])
    stands = F.col("n") + F.col("longer")
    seldom = (stands >= OFTEN) & (F.col("ended") + F.col("others") < ENDING_SHARE * stands)
    known = materialize(known.where(~seldom & ((F.col("n") > 0) | (F.col("longer") == 0))).select("key", (F.col("ended") + F.col("others") > 0).alias("sure")))
    # every text ends one sentence more, with a word that isn't counted above
    n, ended = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ended"), F.lit(0))).first()
    return known.where("sure").select("key"), known.where("NOT sure").select("key"), (n + texts) / max(1, ended + texts)


def _joined(rows: DataFrame, small: DataFrame, column: str, name: str) -> DataFrame:
    known = maybe_broadcast(materialize(small.select(F.col("key").alias(column)))).withColumn(name, F.lit(True))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def judged(docs: DataFrame, doc_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc, source, cut): whether each record's text was cut within a word, sentence or table row.

    Null, empty and blank texts are not cut. Rows with a null id come out with a null id; repeated rows as often as
    they go in, exact copies counting once in the statistics. A null source is a source of its own. Empty tables give
    an empty result. Other columns aren't read.
    """
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col), F.lit("\u0000")).alias("source"))
    filled = F.col("text").isNotNull() & (F.btrim("text", F.lit(" \t\r\n")) != "")
    features = materialize(rows.where(filled).mapInArrow(_feature_batches, f"doc {rows.schema['doc'].dataType.simpleString()}, {_FEATURES}"))
    usual = materialize(features.groupBy("source", "unclosed", "verdict").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("source"))).where(F.col("all") >= STYLE_TEXTS))
    loose = usual.where("unclosed IS NOT NULL").groupBy("source", "unclosed").agg(F.sum("n").alias("n"), F.first("all").alias("all")).where(F.col("n") >= STYLE_SHARE * F.col("all"))
    unended = usual.groupBy("source").agg(F.sum(F.when(F.col("verdict") == OPEN, F.col("n")).otherwise(0)).alias("n"), F.first("all").alias("all")).where(F.col("n") >= UNENDED_SHARE * F.col("all"))
    features = features.join(maybe_broadcast(loose.select("source", "unclosed", F.lit(True).alias("loose"))), ["source", "unclosed"], "left")
    features = features.withColumn("verdict", F.when(F.col("unclosed").isNotNull() & F.col("loose").isNull(), CUT).otherwise(F.col("verdict"))).drop("loose", "unclosed")
    names = ("line", "ahead", "lead", "word", "first", "length", "row", "words", "lines", "single")
    open_ = features.where(F.col("verdict") == OPEN).select("doc", "source", "chars", "bytes", "copy", "tail", F.when(F.col("stub").isNotNull(), F.xxhash64("stub")).alias("behind"), *(F.get("keys", F.lit(k)).alias(n) for k, n in enumerate(names)))
    open_ = open_.withColumn("final", F.when(F.col("single") == 1, F.xxhash64(F.regexp_extract("tail", _FINAL, 1))))

    short = F.col("words") <= 3
    lines = _complete(open_, features)
    # the line before is a sign-off if it nearly always stands before a short last line
    ahead = open_.where("ahead <> 0").groupBy(F.col("ahead").alias("key")).agg(F.count("*").alias("n"), F.avg(short.cast("int")).alias("share")).where((F.col("n") >= RECURS) & (F.col("share") >= 0.8))
    leads, words, rowed = _recurring(open_, "lead"), _recurring(open_.where("lead <> 0"), "word", 2), _recurring(open_, "row")
    # 'Forecaster X': a first word whose lines, in texts of any verdict, nearly always have the same few words
    firsts = features.where("begins <> 0").groupBy(F.col("begins").alias("first")).agg(F.count_distinct("copy").alias("n"))
    lengths = open_.where("lines > 1 AND words <= 3").groupBy(F.col("length").alias("key"), "first").agg(F.count_distinct("copy").alias("m")).join(firsts, "first")
    lengths = lengths.where((F.col("m") >= RECURS) & (F.col("m") >= NAMED_SHARE * F.col("n")))
    # the beginnings of first cells, of the lengths that stand behind table rows
    stubs = materialize(features.where((F.col("verdict") == OPEN) & F.col("stub").isNotNull()).select(F.xxhash64("stub").alias("key"), F.length("stub").alias("size")).distinct())
    cells = features.select(F.explode("cells").alias("cell")).distinct()
    begun = _prefixes(cells, "cell", stubs).join(maybe_broadcast(stubs.select("key")), "key", "left_semi").select("key").distinct()
    headlines, unsure, mean = _final_words(open_, rows, features.count())
    marked = open_
    for small, column, name in ((headlines, "final", "headline"), (unsure, "final", "unsure"), (lines, "line", "known_line"), (ahead, "ahead", "signed"), (leads, "lead", "led"), (words, "word", "listed"), (lengths, "length", "named"), (rowed, "row", "tabled"), (begun, "behind", "begun"), (unended.select(F.col("source").alias("key")), "source", "unended")):
        marked = _joined(marked, small, column, name)
    limit = {m: maybe_broadcast(materialize(source_limits(features, m)).withColumnRenamed("limit", f"most_{m}")) for m in ("chars", "bytes")}
    for limits in limit.values():
        marked = marked.join(limits, "source", "left")
    at_limit = F.coalesce(F.col("chars") == F.col("most_chars"), F.lit(False)) | F.coalesce(F.col("bytes") >= F.col("most_bytes") - 3, F.lit(False))
    whole = ~F.col("begun") & (F.col("known_line") | (~at_limit & (F.col("headline") | (F.col("unsure") & (F.col("words") <= mean)) | F.col("unended") | (F.col("signed") & short) | (F.col("led") & F.col("listed")) | F.col("named") | F.col("tabled"))))
    open_cut = marked.select("doc", "source", (~whole).alias("cut"))

    inner = features.select(F.explode("inner").alias("key"), "copy").distinct().groupBy("key").agg(F.count("*").alias("texts"))
    trailing = _joined(features.where(F.col("verdict") == OMISSION).select("doc", "source", "chars", "bytes", F.get("keys", F.lit(0)).alias("phrase")), inner, "phrase", "thought")
    for limits in limit.values():
        trailing = trailing.join(limits, "source", "left")
    trailing = trailing.withColumn("thought", F.col("thought") & ~at_limit)
    rest = features.where(F.col("verdict") < OMISSION).select("doc", "source", (F.col("verdict") == CUT).alias("cut"))
    blank = rows.where(~F.coalesce(filled, F.lit(False))).select("doc", "source", F.lit(False).alias("cut"))
    result = rest.unionByName(blank).unionByName(open_cut).unionByName(trailing.select("doc", "source", (~F.col("thought")).alias("cut")))
    return result.withColumn("source", F.nullif("source", F.lit("\u0000")))


def truncation_rates(judged_rows: DataFrame) -> DataFrame:
    """(source, records, cut, share): how often each source truncates."""
    counted = judged_rows.groupBy("source").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"))
    return counted.withColumn("share", F.round(F.col("cut") / F.col("records"), 6))
