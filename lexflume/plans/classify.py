"""Queries of text classification: forum posts (label 1) against other documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.operators import textclass
from lexflume.session import materialize, table
from lexflume.sources.readers import mail_parts


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("kind", F.substring_index("source", "_", -1))
    return textclass.with_tokens(textclass.labels_of(rows, "kind", "forum"), "text").select("doc_id", "label", "tokens")


def spam_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


def spam_vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the entries of vocabulary B over all documents; entries of several words count with n-grams."""
    counted = textclass.fixed_counts(textclass.with_ngrams(_labelled(spark, sf_dir), 3), textclass.VOCABULARY_B)
    from pyspark.ml.functions import vector_to_array

    long = counted.select("label", F.posexplode(vector_to_array("features")).alias("at", "n"))
    names = F.array(*(F.lit(w) for w in textclass.VOCABULARY_B))
    return long.groupBy("label", F.element_at(names, F.col("at") + 1).alias("entry")).agg(F.sum("n").cast("long").alias("n"))


def spam_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textclass.bayes_log_odds(_labelled(spark, sf_dir), "doc_id").select("word", F.round("log_odds", 6).alias("log_odds"))


def spam_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC of the text length as a score."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("kind", F.substring_index("source", "_", -1))
    return textclass.roc_auc(textclass.labels_of(rows, "kind", "forum"), "n_chars").select(F.round("auc", 9).alias("auc"), "positives", "negatives")


def _trained(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = materialize(_labelled(spark, sf_dir))
        train, test = textclass.split_rows(rows, "doc_id")
        words = textclass.learned_counts(train)
        train = materialize(words.transform(train).select("doc_id", "label", "features"))
        model = textclass.classifier(kind, train.count()).fit(train)
        return textclass.roc_auc(textclass.scored(model, words.transform(test), "doc_id"))

    return query


def mail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "documents").where(F.startswith("text", F.lit("From: ")))
    return mail_parts(mails, "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (spam_labels, spam_vocab_counts, spam_log_odds, spam_auc, mail_bodies)} | {f"spam_{k}": _trained(k) for k in ("logistic", "tree", "bayes")}

_ROWS = r"""rows AS (SELECT doc_id, n_chars, CASE WHEN string_split(source, '_')[-1] = 'forum' THEN 1 ELSE 0 END AS label,
  list_filter(coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []), lambda w: length(w) >= 2) AS w FROM documents WHERE source IS NOT NULL)"""
_ENTRIES = ", ".join(f"('{w}')" for w in textclass.VOCABULARY_B)

ORACLE = {
    "mail_bodies": r"""SELECT doc_id, nullif(regexp_extract('\n' || split_part(text, chr(10) || chr(10), 1), '\nSubject: ([^\n]*)', 1), '') AS subject, substr(text, position(chr(10) || chr(10) IN text) + 2) AS body
      FROM documents WHERE starts_with(text, 'From: ') AND contains(text, chr(10) || chr(10))
      UNION ALL SELECT doc_id, nullif(regexp_extract('\n' || text, '\nSubject: ([^\n]*)', 1), ''), '' FROM documents WHERE starts_with(text, 'From: ') AND NOT contains(text, chr(10) || chr(10))""",
    "spam_labels": f"WITH {_ROWS} SELECT label, count(*) AS docs, sum(len(w))::BIGINT AS tokens FROM rows GROUP BY label",
    "spam_vocab_counts": f"""WITH {_ROWS}, v AS (SELECT * FROM (VALUES {_ENTRIES}) t(entry)),
      grams AS (SELECT label, unnest(w) AS g FROM rows UNION ALL SELECT label, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM rows
                UNION ALL SELECT label, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM rows),
      c AS (SELECT label, g AS entry, count(*) AS n FROM grams WHERE g IN (SELECT entry FROM v) GROUP BY ALL)
      SELECT label, entry, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT label FROM rows) CROSS JOIN v LEFT JOIN c USING (label, entry)""",
    "spam_log_odds": f"""WITH {_ROWS}, c AS (SELECT word, sum(label)::DOUBLE AS c1, sum(1 - label)::DOUBLE AS c0 FROM (SELECT label, unnest(w) AS word FROM rows) GROUP BY word), t AS (SELECT sum(c1) AS t1, sum(c0) AS t0, count(*) AS v FROM c)
      SELECT word, round(ln((c1 + 1) / (t1 + v)) - ln((c0 + 1) / (t0 + v)), 6) AS log_odds FROM c, t""",
    "spam_auc": f"""WITH {_ROWS}, c AS (SELECT n_chars AS s, sum(label) AS p, sum(1 - label) AS q FROM rows WHERE n_chars IS NOT NULL GROUP BY n_chars),
      x AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
      SELECT round(sum(p * (below + q / 2.0::DOUBLE)) / sum(p)::DOUBLE / sum(q)::DOUBLE, 9) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM x""",
}
