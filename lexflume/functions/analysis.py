"""Text analysis as column expressions: positional tokens, filters, stop words; stemming on distinct terms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexflume.functions.porter import stem_word

#: Letters, digits and the underscore of any script; the same in Java and RE2, where \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"^[\p{L}\p{N}]+$"
ALPHA = r"^\p{L}+$"
_SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
#: Words, single punctuation marks, runs of line ends: all of them take a position.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]|[\n\r]+"


def word_list(text: Column) -> Column:
    """Words (with underscores) in text order."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def clean_words(text: Column) -> Column:
    """Tokens of letters only, joined by blanks."""
    return F.array_join(F.filter(word_list(text), lambda t: t.rlike(ALPHA)), " ")


def not_stopped_substring(term: Column, stop_text: str) -> Column:
    """True unless the term occurs anywhere inside the stop-list text."""
    return F.instr(F.lit(stop_text), term) == 0


@F.pandas_udf(StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    """Porter stems; each distinct term of a batch is stemmed once."""
    known = {t: stem_word(t) for t in terms.dropna().unique()}
    return pd.Series([known.get(t) for t in terms], dtype=object)


def stem_terms(tokens: DataFrame, column: str = "term") -> DataFrame:
    """Replace the column by its stems. Only the distinct terms go through Python; the join back is a hash join on the vocabulary."""
    vocabulary = tokens.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_stem", porter_stem(column))
    return tokens.join(vocabulary, column, "left").withColumn(column, F.col("_stem")).drop("_stem")


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.

    positional: tokens carry positions that count punctuation marks and line ends, and only tokens of letters and digits
    stay; else plain words (with underscores). stop_mode: 'exact' drops terms in `stopwords`, 'substring' drops terms
    that occur inside the stop words written one per line. double_stem stops and stems once more.
    trailer appends the token 'ln' to every document.
    """

    lowercase: bool = True
    positional: bool = True
    stopwords: frozenset[str] = field(default_factory=frozenset)
    stop_mode: str = "exact"
    stem: bool = False
    double_stem: bool = False
    trailer: bool = False

    def tokens(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc_id, pos, term). Null and empty texts have no tokens; rows without an id are ignored."""
        text = F.col(text_col)
        if self.trailer:
            text = F.concat(text, F.lit("\\ln"))
        if self.lowercase:
            text = F.lower(text)
        found = F.regexp_extract_all(text, F.lit(TOKEN if self.positional else WORD), 0)
        rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("pos", "term"))
        if self.positional:
            rows = rows.where(F.col("term").rlike(ALNUM))
        rows = self._stopped(rows)
        for _ in range((1 + self.double_stem) if self.stem or self.double_stem else 0):
            rows = self._stopped(stem_terms(rows)) if self.double_stem else stem_terms(rows)
        return rows.select("doc_id", "pos", "term")

    def _stopped(self, rows: DataFrame) -> DataFrame:
        if not self.stopwords:
            return rows
        if self.stop_mode == "substring":
            return rows.where(not_stopped_substring(F.col("term"), "\n".join(sorted(self.stopwords))))
        return rows.where(~F.col("term").isin(sorted(self.stopwords)))

    def queries(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(query_id, qpos, term), duplicates and order kept."""
        return self.tokens(texts, id_col, text_col).select(F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), "term")


def stop_set(words: Iterable[str]) -> frozenset[str]:
    return frozenset(w.strip() for w in words if w.strip())
