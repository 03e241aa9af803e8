"""Text classification: word counts over fixed or learned vocabularies, three classifiers, ROC AUC, leading features."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.functions.analysis import word_list
from lexflume.operators.numbering import chained, range_parts

#: Words of the two fixed vocabularies (fixed values).
VOCABULARY_A = (
    "free", "click here", "winner", "won", "prize", "money", "cash", "porn", "access now", "apply now", "credit", "buy now", "limited time",
    "call now", "congratulations", "earn money", "give away",
)
VOCABULARY_B = (
    "free", "spam", "click", "buy", "clearance", "shopper", "order", "earn", "cash", "extra", "money", "double", "collect", "credit", "check",
    "affordable", "fast", "price", "loans", "profit", "refinance", "hidden", "freedom", "chance", "miracle", "lose", "home", "remove",
    "success", "virus", "malware", "ad", "subscribe", "sales", "performance", "valium", "medicine", "diagnostics", "million", "join", "deal",
    "unsolicited", "trial", "prize", "now", "legal", "bonus", "limited", "instant", "luxury", "celebrity", "only", "compare", "win", "viagra",
    "$$$", "$discount", "click here", "meet singles", "incredible deal", "lose weight", "act now", "100% free", "fast cash", "million dollars",
    "lower interest rate", "visit our website", "no credit check",
)

def with_tokens(rows: DataFrame, text_col: str, column: str = "tokens") -> DataFrame:
    """Adds the words of two or more characters; null texts have none."""
    found = F.filter(word_list(F.lower(text_col)), lambda w: F.length(w) >= 2)
    return rows.withColumn(column, F.coalesce(found, F.array().cast("array<string>")))


def with_ngrams(rows: DataFrame, most: int = 2, column: str = "tokens") -> DataFrame:
    """Adds the n-grams up to `most` words to the tokens, so that vocabulary entries of several words can match."""
    for n in range(2, most + 1):
        rows = NGram(n=n, inputCol=column, outputCol=f"_{n}").transform(rows)
    return rows.withColumn(column, F.concat(column, *(f"_{n}" for n in range(2, most + 1)))).drop(*(f"_{n}" for n in range(2, most + 1)))


def fixed_counts(rows: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY_A, column: str = "tokens") -> DataFrame:
    """The rows with `features`, the counts of the vocabulary's entries (entries that no token equals stay 0)."""
    return CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol=column, outputCol="features").transform(rows)


def learned_counts(train: DataFrame, column: str = "tokens", least: float = 0.005, most: float = 0.995) -> CountVectorizerModel:
    return CountVectorizer(inputCol=column, outputCol="features", minDF=least, maxDF=most).fit(train)


def split_rows(rows: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same split every time and for copies of a key."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    return rows.where(at >= test_share), rows.where(at < test_share)


def classifier(kind: str, n: int, c: float = 0.01):
    """logistic (L1), tree or bayes."""
    if kind == "logistic":
        return LogisticRegression(elasticNetParam=1.0, regParam=1 / (c * max(1, n)), standardization=False)
    return DecisionTreeClassifier(maxDepth=30) if kind == "tree" else NaiveBayes(modelType="multinomial")


def scored(model, rows: DataFrame, id_col: str) -> DataFrame:
    return model.transform(rows).select(id_col, "label", vector_to_array("probability")[1].alias("score"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (auc, positives, negatives): the exact area by ranks, ties counting half. Scores are grouped first, so the
    window runs over partial counts per range of distinct scores: totals of ranges are chained, no range is gathered."""
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    laid = range_parts(counts, "s")
    upto = F.coalesce(F.sum("q").over(W.partitionBy("_part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = laid.withColumn("own", upto).join(chained(laid, F.col("q")), "_part").agg(F.sum(F.col("p") * (F.col("own") + F.col("below") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return wins.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / F.col("positives") / F.col("negatives")).alias("auc"), "positives", "negatives")


def bayes_log_odds(train: DataFrame, id_col: str, vocabulary: tuple[str, ...] | None = None, smoothing: float = 1.0) -> DataFrame:
    """(word, log_odds): ln P(word | 1) - ln P(word | 0) of the multinomial model with additive smoothing, as one aggregate
    over (id, label, tokens); the words are those of the vocabulary, or all."""
    words = train.select("label", F.explode("tokens").alias("word"))
    if vocabulary:
        words = words.where(F.col("word").isin(list(vocabulary)))
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("c1"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("c0"))
    total = counts.agg(F.struct(F.sum("c1").alias("t1"), F.sum("c0").alias("t0"), F.count("*").alias("v"))).scalar()
    rows = counts.withColumn("t", total)
    ratio = lambda c, t: F.ln((F.col(c) + smoothing) / (F.col(f"t.{t}") + smoothing * F.col("t.v")))
    return rows.select("word", (ratio("c1", "t1") - ratio("c0", "t0")).alias("log_odds"))


def top_features(vocabulary: list[str], weights: list[float], k: int = 6) -> list[tuple[str, float]]:
    """The entries of the largest weights, each with its own name."""
    return sorted(zip(vocabulary, weights), key=lambda x: (-abs(x[1]), x[0]))[:k]


def top_rows(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.asc(scores.columns[0])).limit(k)


def labels_of(rows: DataFrame, column: str, positive: str = "spam") -> DataFrame:
    """`label`: 1 for the positive mark, 0 for others, null for null."""
    return rows.withColumn("label", F.when(F.col(column) == positive, 1).when(F.col(column).isNotNull(), 0))
