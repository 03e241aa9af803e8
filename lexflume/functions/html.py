"""Text, title, language and links of HTML pages as column expressions; admission of pages by language and URL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexflume.functions.urls import UNWANTED

#: Parts of URLs of pages that aren't wanted: all that is never followed but one site.
BLOCKED = tuple(part for part in UNWANTED if part != "www.vatican.va")
#: The predefined entities of markup and the fixed blank, the ampersand last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    """The text with entities as characters; numeric ones, decimal and hexadecimal, one after the other. `&amp;` comes last, so
    what is escaped twice is decoded once."""
    one = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"

    def character(code: Column) -> Column:
        number = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        return F.when((number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")

    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(one), 1))
    text = F.when(~F.contains(text, F.lit("&#")), text).otherwise(F.reduce(codes, text, lambda so_far, code: F.replace(so_far, F.concat(F.lit("&#"), code, F.lit(";")), character(code))))
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def paragraphs(html: Column) -> Column:
    """The texts of all <p> elements: tags and line feeds removed, runs of blanks made one, empty ones left out, each followed by a blank."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), 1)
    bare = F.transform(found, lambda p: F.regexp_replace(F.replace(_decoded(F.regexp_replace(p, r"(?s)<[^>]*>", "")), F.lit("\n"), F.lit("")), " {2,}", " "))
    kept = F.filter(bare, lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit(" "))), "")


def title(html: Column) -> Column:
    """The first title, or null."""
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title"), _decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)))


def language(html: Column, default: str = "en") -> Column:
    found = F.regexp_extract(html, r"""(?is)<html[^>]*\slang\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.when(html.isNull(), None).when(found != "", found).otherwise(default)


def links(html: Column) -> Column:
    """All non-empty href values of <a> elements in document order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    return F.filter(F.transform(bare, _decoded), lambda x: x != "")


def admitted(lang: Column, url: Column, wanted: str = "en", blocked: tuple[str, ...] = BLOCKED) -> Column:
    """Whether the language contains `wanted` and the URL none of the blocked parts."""
    return F.contains(F.lower(lang), F.lit(wanted)) & ~url.rlike("(?i)" + "|".join(map(re.escape, blocked)))
