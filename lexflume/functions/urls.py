"""URL functions as column expressions; a vectorised function only where a path has to be walked."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parts of URLs that are never followed (fixed values).
UNWANTED = (
    ".jpg", ".svg", ".png", ".pdf", ".gif", "youtube", "edit", "footer", "sidebar", "cite",
    "special", "mailto", ".webm", "tel:", "javascript", "www.vatican.va", ".ogv", "amazon",
)


def domain(url: Column) -> Column:
    """What stands between // and the next slash, up to its last word character (the port stays)."""
    return F.regexp_extract(url, r"//([^/]*[\p{L}\p{N}_])", 1)


def host(url: Column) -> Column:
    """The network location as written (with user and port), empty if there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def _climbed(base: str | None, link: str | None) -> str | None:
    """A link of leading '../' steps against its base: as many folders of the base are left as there are steps."""
    if base is None or link is None:
        return None
    steps = 0
    while link.startswith("../"):
        link, steps = link[3:], steps + 1
    scheme, _, rest = base.partition("//")
    folders = rest.split("/")[:-1] or [rest]
    kept = folders[: max(1, len(folders) - steps)]
    return f"{scheme}//{'/'.join([*kept, link])}" if _ else ""


@F.pandas_udf(StringType())
def _climb(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([_climbed(b, x) if isinstance(b, str) and isinstance(x, str) else None for b, x in zip(base, link)], dtype=object)


@F.pandas_udf(StringType())
def _join(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str, x: str) -> str | None:
        try:
            return urljoin(b, x)
        except ValueError:
            return ""

    return pd.Series([one(b, x) if isinstance(b, str) and isinstance(x, str) else None for b, x in zip(base, link)], dtype=object)


def canonicalize(base: Column, link: Column, resolve_relative: bool = False, exact_ports: bool = False, unwanted: tuple[str, ...] = UNWANTED) -> Column:
    """The canonical form of a link found on page `base`, or '' if it isn't followed; null for a null link.

    Backslashes become slashes; line ends, tabs and blanks go; the fragment goes; links without a word character or
    with an unwanted part are ''; links of leading '../' are resolved against the base; https loses port 443, http port
    80; https becomes http; repeated slashes in the path become one; the host is lower-cased. Other relative links have
    no host and are '' unless `resolve_relative`. The ports' digits go wherever they stand behind a colon (so ':8080'
    leaves '80'); `exact_ports` takes only whole ports of the host.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(link, r"\\+", "/"), r"[\n\t ]", ""), r"#.*$", "")
    if resolve_relative:
        plain = F.when(F.instr(plain, "//") > 0, plain).otherwise(_join(base, plain))
    else:
        plain = F.when(plain.rlike(r"^(?:\.\./)+[^/]"), _climb(base, plain)).otherwise(plain)
    found = _let(plain, lambda p: F.when(_unwanted(p, unwanted), "").otherwise(_let(_without_port(p, exact_ports), _lowered)))
    return F.when(link.isNull(), None).otherwise(found)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: expressions that are copied into every place of their use outgrow a method."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unwanted(link: Column, unwanted: tuple[str, ...]) -> Column:
    return ~link.rlike(r"[\p{L}\p{N}_]") | link.rlike("(?i)" + "|".join(map(re.escape, unwanted)))


def _without_port(link: Column, exact: bool) -> Column:
    cut = {p: (rf"^([^/]*//[^/]*):{p}(?![0-9])", "$1") if exact else (f":{p}", "") for p in (443, 80)}
    port = F.when(link.rlike("(?i)^https"), F.regexp_replace(link, *cut[443])).when(link.rlike("(?i)^http"), F.regexp_replace(link, *cut[80])).otherwise(link)
    return F.regexp_replace(F.regexp_replace(port, r"(?i)https", "http"), r"([\p{L}\p{N}_])//+", "$1/")


def _lowered(link: Column) -> Column:
    """The link with its scheme and host in lower case; '' without a host."""
    lead = F.regexp_extract(link, r"^([^/]*//[^/]*)", 1)
    return F.when(~link.rlike("^[^/]*//"), "").otherwise(F.concat(F.lower(lead), F.regexp_replace(link, r"^[^/]*//[^/]*", "")))


def _walked(url: str) -> str:
    try:
        parts = urlsplit(url.strip())
        location = parts.netloc.lower()
        if parts.port is not None:
            location = (parts.hostname or "").lower()
    except ValueError:
        return ""
    stack: list[str] = []
    segments = re.sub(r"/+", "/", parts.path).split("/")
    for segment in segments:
        if segment == "..":
            if len(stack) > 1:  # the root stays
                stack.pop()
        elif segment != ".":
            stack.append(segment)
    return urlunsplit((parts.scheme.lower(), location, "/".join(stack), parts.query, ""))


@F.pandas_udf(StringType())
def index_key(urls: pd.Series) -> pd.Series:
    """The key of a page in the index: scheme and host in lower case, no explicit port, no fragment, single slashes, '.' and '..' resolved (at the root they stop)."""
    return pd.Series([_walked(u) if isinstance(u, str) else None for u in urls], dtype=object)
