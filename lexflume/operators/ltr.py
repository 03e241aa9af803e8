"""Learning to rank: label pairs, features from runs, scaling, folds, and a kernel classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.operators.numbering import numbered
from lexflume.operators.skew import key_quantiles
from lexflume.session import materialize, release

#: What a pair gets where a model hasn't ranked it (fixed values).
MISSING = {"bm25": 0.0, "laplace": -5000.0, "jm": -5000.0, "tfidf": 0.0, "okapi": 0.0}


def label_pairs(qrels: DataFrame, run: DataFrame, negatives: int = 1000, exclude_relevant: bool = False) -> DataFrame:
    """(query_id, doc_id, label): judged pairs with grade 1 or 0, and unjudged-as-0 pairs from a run, in run order, until a
    query has `negatives` of label 0. Unless `exclude_relevant`, a relevant document may come in again with label 0."""
    judged = qrels.where("grade IN (0, 1)").select("query_id", "doc_id", F.col("grade").cast("int").alias("label")).distinct()
    have = judged.where("label = 0").groupBy("query_id").agg(F.count("*").alias("have"))
    fresh = run.select("query_id", "doc_id", "rank").join(judged.select("query_id").distinct(), "query_id", "left_semi")
    fresh = fresh.join(judged.where("label = 0").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    if exclude_relevant:
        fresh = fresh.join(judged.where("label = 1").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "doc_id"))
    more = fresh.withColumn("place", place).join(have, "query_id", "left").where(F.col("place") <= negatives - F.coalesce("have", F.lit(0)))
    return judged.unionByName(more.select("query_id", "doc_id", F.lit(0).alias("label")))


def feature_frame(pairs: DataFrame, runs: dict[str, DataFrame], missing: dict[str, float] | None = None) -> DataFrame:
    """The pairs with one column per model: its score, or the model's value for missing ones. All runs are united and
    pivoted by one aggregate, so there is one join for any number of models."""
    missing = MISSING if missing is None else missing
    one = None
    for name, run in runs.items():
        part = run.select("query_id", "doc_id", F.lit(name).alias("model"), "score")
        one = part if one is None else one.unionByName(part)
    wide = one.groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("model") == name, F.col("score"))).alias(name) for name in runs))
    return pairs.join(wide, ["query_id", "doc_id"], "left").na.fill({name: missing.get(name, 0.0) for name in runs})


def percentiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """The exact percentiles of each column, interpolated between ranks; None without values. Ranks are resolved by
    histograms of mergeable counts (`key_quantiles`), so no column's values are gathered."""
    counts = rows.agg(*(F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    ranks = {c: sorted({r for p in shares for r in (int(p * (counts[c] - 1)), min(counts[c] - 1, int(p * (counts[c] - 1)) + 1))}) for c in columns if counts[c]}
    wanted = sorted({(r + 0.5) / counts[c] for c, own in ranks.items() for r in own})
    if not wanted:
        return {c: [None] * len(shares) for c in columns}
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    found = {(r.key, r.p): r.value for r in key_quantiles(long, "column", "value", tuple(wanted)).collect()}

    def at(c: str, share: float) -> float | None:
        n = counts[c]
        if not n:
            return None
        low = int(share * (n - 1))
        a, b = (found[c, (r + 0.5) / n] for r in (low, min(n - 1, low + 1)))
        return a + (b - a) * (share * (n - 1) - low)

    return {c: [at(c, share) for share in shares] for c in columns}


def robust_scaled(rows: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Columns centred on the median and divided by the interquartile range (1 if that is 0); a column without values stays null."""
    shares = (0.25, 0.5, 0.75)
    if exact:
        found = percentiles(rows, columns, shares)
    else:
        found = rows.agg(*(F.percentile_approx(c, F.array(*map(F.lit, shares)), 10_000).alias(c) for c in columns)).first().asDict()
    scaled = {}
    for c in columns:
        low, middle, high = found[c] or (None, None, None)
        scaled[c] = F.lit(None).cast("double") if middle is None else (F.col(c) - middle) / ((high - low) or 1.0)
    return rows.withColumns(scaled)


def query_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """The rows with `fold`: the queries in order, cut into `folds` runs of equal size."""
    ids = numbered(rows.select("query_id").distinct(), "at", "query_id")
    n = ids.agg(F.count("*")).scalar()
    return rows.join(ids.withColumn("n", n).select("query_id", F.floor(F.col("at") * folds / F.col("n")).cast("int").alias("fold")), "query_id")


#: sin(2 pi u) / u as a polynomial in u * u, exact to rounding for |u| <= 1/4.
_SINE = np.polynomial.Chebyshev.interpolate(lambda square: 2 * pi * np.sinc(2 * np.sqrt(square)), 9, domain=[0, 1 / 16]).convert(kind=np.polynomial.Polynomial).coef
BLOCK, ROUNDS = 256, 100


def cosines(turns: np.ndarray) -> np.ndarray:
    """cos(2 pi t) of every t (overwritten): equal to numpy's double cosine but for rounding, in a third of its time."""
    turns -= np.rint(turns)
    np.abs(turns, out=turns)
    np.subtract(0.25, turns, out=turns)
    square = turns * turns
    out = np.full_like(turns, _SINE[-1])
    for a in _SINE[-2::-1]:
        out *= square
        out += a
    out *= turns
    return out


def _shares(logits: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), without overflow."""
    small = np.exp(-np.abs(logits))
    return np.where(logits >= 0, 1.0, small) / (1.0 + small)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix by Gauss-Jordan sweeps. The threads of BLAS, which numpy's `inv` uses,
    were seen to hang in a driver's process."""
    out = matrix.copy()
    for k in range(len(out)):
        pivot, row, column = out[k, k], out[k] / out[k, k], out[:, k].copy()
        out -= np.outer(column, row)
        out[k], out[:, k] = row, -column / pivot
        out[k, k] = 1 / pivot
    return out


def _applied(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


class KernelClassifier:
    """Probabilities from a Gaussian kernel exp(-gamma |x - y|^2), by random Fourier features (Rahimi and Recht, 2007) and
    logistic regression: an approximation of a kernel machine that trains in passes over the data.

    The regression minimises the loss of all rows + |beta|^2 / 2c (intercept free) and is solved to its optimum: logits of any
    row are settled to about 1e-6. A pass computes the Fourier features of a block of rows again, as they take fifty times the
    room of their columns, and sums gradients and curvatures; the sums meet by row of the matrix, so the driver gets one matrix a fold.
    """

    def __init__(self, columns: list[str], gamma: float = 0.4, c: float = 1.0, dimensions: int = 200, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.columns, self.c = columns, c
        self.weights = rng.normal(0.0, sqrt(2 * gamma), (dimensions, len(columns)))
        self.shifts = rng.uniform(0, 2 * pi, dimensions)
        self.coefficients: np.ndarray | None = None  # a row for each model, its intercept last

    def _mapping(self) -> Callable[[np.ndarray], np.ndarray]:
        """Fourier features and a 1 of each row, by operations on single elements: equal rows have equal features."""
        turns, start, scale = self.weights.T / (2 * pi), self.shifts / (2 * pi), sqrt(2 / len(self.shifts))

        def mapped(values: np.ndarray) -> np.ndarray:
            at = np.tile(start, (len(values), 1))
            for k in range(values.shape[1]):
                at += values[:, k, None] * turns[k]
            out = np.ones((len(values), len(start) + 1))
            np.multiply(cosines(at), scale, out=out[:, :-1])
            return out

        return mapped

    def _sums(self, rows: DataFrame, models: np.ndarray, curved: bool) -> dict[tuple[int, int], np.ndarray]:
        """Sums over `rows` (_fold, _label and the columns). Curved: of the first model, for each fold apart, the matrix rows
        (curvature, gradient) and behind them (loss, rows, rows of label 1). Else for each model (loss, gradient) over all folds but its own."""
        mapped, size = self._mapping(), models.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                fold, label, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                values = np.stack([v.astype(float) for v in values], axis=1)
                if not (np.isfinite(values).all() and np.isin(label, (0, 1)).all()):
                    raise ValueError("features must be finite numbers and labels 0 or 1")
                order = np.argsort(fold, kind="stable")
                cuts = np.unique(np.concatenate([np.arange(0, len(order), BLOCK), np.flatnonzero(np.diff(fold[order])) + 1 if curved else np.empty(0, int), [len(order)]]).astype(int))
                for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                    part = order[begin:end]
                    x, y, own = mapped(values[part]), label[part].astype(float), fold[part]
                    if curved:
                        logits = x @ models[0]
                        share = _shares(logits)
                        sums = found.setdefault(int(own[0]), np.zeros((size + 1, size + 1)))
                        root = x * np.sqrt(share * (1 - share))[:, None]
                        sums[:size, :size] += root.T @ root
                        sums[:size, size] += x.T @ (share - y)
                        sums[size, :3] += (np.logaddexp(0, logits) - y * logits).sum(), len(y), y.sum()
                    else:
                        logits = x @ models.T
                        counts = own[:, None] != np.arange(len(models))
                        gradient = (counts * (_shares(logits) - y[:, None])).T @ x
                        loss = np.where(counts, np.logaddexp(0, logits) - y[:, None] * logits, 0.0).sum(axis=0)
                        for k in range(len(models)):
                            found.setdefault(k, np.zeros((1, size + 1)))[0] += np.concatenate([[loss[k]], gradient[k]])
            yield from _sum_batch({(k, at): row for k, sums in found.items() for at, row in enumerate(sums)})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, at, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found[k, at] = found.get((k, at), 0.0) + np.frombuffer(sums)
            yield from _sum_batch(found)

        kind = "fold int, at int, sums binary"
        parts = rows.select("_fold", "_label", *self.columns).mapInArrow(partial, kind)
        return {(r.fold, r.at): np.frombuffer(r.sums) for r in parts.repartition("fold", "at").mapInArrow(whole, kind).collect()}

    def _solve(self, rows: DataFrame, folds: int | None = None) -> None:
        """One model of all rows, or for each fold one of the other folds' rows. Newton's method on all rows leads close to
        every fold's optimum; from there all models go on together, by BFGS from their own exact curvature."""
        size, ridge = len(self.shifts) + 1, np.append(np.full(len(self.shifts), 1 / self.c), 0.0)
        beta, before = np.zeros(size), None
        slack, small = (lambda value: 1e-10 * abs(value)), (lambda value: max(1e-6, 1e-13 * abs(value)))
        for _ in range(ROUNDS):
            own = np.zeros((folds or 1, size + 1, size + 1))
            for (k, at), sums in self._sums(rows, beta[None], curved=True).items():
                own[k, at] = sums
            total = own.sum(axis=0)
            value, (_, n, ones) = total[size, 0] + ridge @ beta**2 / 2, total[size, :3]
            if ones in (0, n):
                break
            if before and not value <= before[1] + slack(before[1]):
                beta = (beta + before[0]) / 2
                continue
            gradient = total[:size, size] + ridge * beta
            step = _applied(_inverse(total[:size, :size] + np.diag(ridge)), gradient)
            if gradient @ step <= (1.0 if folds else small(value)) ** 2:
                break
            before, beta = (beta, value), beta - step
        else:
            raise RuntimeError(f"regression not settled in {ROUNDS} rounds")
        models = np.tile(beta, (folds or 1, 1))
        states = {}
        for k in range(len(models)):
            rest = total - own[k] if folds else total
            _, n, ones = np.rint(rest[size, :3])
            if not n and own[k, size, 1]:
                raise ValueError(f"no rows outside fold {k} to train its model")
            if ones in (0, n):  # one class only: no coefficients, and its probability is 1
                models[k] = np.append(np.zeros(size - 1), np.inf if ones else -np.inf)
            else:
                inverse = _inverse(rest[:size, :size] + np.diag(ridge))
                states[k] = [rest[size, 0] + ridge @ beta**2 / 2, rest[:size, size] + ridge * beta, inverse, 1.0]
        for _ in range(ROUNDS):
            steps = {k: _applied(inverse, gradient) for k, (_, gradient, inverse, _) in states.items()}
            steps = {k: step for k, step in steps.items() if not states[k][1] @ step <= small(states[k][0]) ** 2}
            if not steps:
                break
            tried = models.copy()
            for k, step in steps.items():
                tried[k] -= states[k][3] * step
            sums = self._sums(rows, np.where(np.isfinite(tried), tried, 0.0), curved=False)
            for k in steps:
                value, gradient, inverse, part = states[k]
                loss, slope = sums[k, 0][0] + ridge @ tried[k] ** 2 / 2, sums[k, 0][1:] + ridge * tried[k]
                if not loss <= value + slack(value):
                    states[k][3] = part / 2
                    continue
                moved, bent = tried[k] - models[k], slope - gradient
                if (fall := moved @ bent) > 0:
                    mixed = _applied(inverse, bent)
                    inverse = inverse + (np.outer(moved, moved) * (1 + bent @ mixed / fall) - np.outer(mixed, moved) - np.outer(moved, mixed)) / fall
                models[k], states[k] = tried[k], [loss, slope, inverse, 1.0]
        else:
            raise RuntimeError(f"regression not settled in {ROUNDS} rounds")
        self.coefficients = models

    def fit(self, rows: DataFrame, label: str = "label") -> KernelClassifier:
        laid = materialize(rows.select(F.lit(0).alias("_fold"), F.col(label).alias("_label"), *self.columns))
        self._solve(laid)
        release(laid)
        return self

    def fit_folds(self, rows: DataFrame, folds: int, fold: str = "fold", label: str = "label") -> KernelClassifier:
        """A model for each fold (0 to `folds` - 1), trained on the rows of the others. `rows` is read in every pass."""
        self._solve(rows.select(F.col(fold).alias("_fold"), F.col(label).alias("_label"), *self.columns), folds)
        return self

    def scores(self, rows: DataFrame, fold: str | None = None) -> DataFrame:
        """The rows with `score`, the probability of label 1, by the model of their fold (or the only one)."""
        mapped, models = self._mapping(), self.coefficients

        @F.pandas_udf("double")
        def shares(values: pd.Series, own: pd.Series) -> pd.Series:
            out, values, own = np.empty(len(values)), values.to_numpy(), own.to_numpy()
            for begin in range(0, len(out), BLOCK):
                part = slice(begin, begin + BLOCK)
                out[part] = _shares((mapped(np.stack(values[part])) * models[own[part]]).sum(axis=1))
            return pd.Series(out)

        return rows.withColumn("score", shares(F.array(*(F.col(c).cast("double") for c in self.columns)), F.col(fold) if fold else F.lit(0)))


def _sum_batch(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        keys = np.array(list(found), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["fold", "at", "sums"])


def cross_validated(rows: DataFrame, columns: list[str], folds: int = 5, **options) -> DataFrame:
    """(query_id, doc_id, rank, score, fold): every fold scored by a model of the others, ranked by score."""
    laid = materialize(query_folds(rows, folds))
    out = KernelClassifier(columns, **options).fit_folds(laid, folds).scores(laid, "fold").select("query_id", "doc_id", "score", "fold")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
