"""The kernel classifier of learning to rank: every fold's model at its own optimum, in few passes over all rows."""

import numpy as np

from lexflume.operators import ltr

SCHEMA = "query_id string, doc_id string, label int, a double, b double"


def made(n=400):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, n), rng.normal(0, 3, n)
    label = (rng.uniform(size=n) < 1 / (1 + np.exp(2 - 2 * a))).astype(int)
    return [(f"q{i % 20:02}", f"d{i:03}", int(label[i]), float(a[i]), float(b[i])) for i in range(n)]


def optimum(x, y, c=1.0):
    x = np.c_[x, np.ones(len(x))]
    ridge, beta = np.diag([1 / c] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x * beta).sum(axis=1)))
        slope = (x * (p - y)[:, None]).sum(axis=0) + (ridge * beta).sum(axis=1)
        curve = (x[:, :, None] * x[:, None, :] * (p * (1 - p))[:, None, None]).sum(axis=0) + ridge
        beta = beta - np.linalg.lstsq(curve, slope, rcond=None)[0]
    return beta


def test_folds_are_scored_by_the_optimum_of_the_others(spark):
    data = made()
    group = "folds of the kernel classifier"
    spark.sparkContext.setJobGroup(group, group)
    out = ltr.cross_validated(spark.createDataFrame(data, SCHEMA), ["a", "b"], dimensions=12).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("others", "others")
    kernel = ltr.KernelClassifier(["a", "b"], dimensions=12)
    values, label = np.array([r[3:] for r in data]), np.array([r[2] for r in data])
    x = np.cos((values[:, :1] * kernel.weights[:, 0] + values[:, 1:] * kernel.weights[:, 1]) + kernel.shifts) * np.sqrt(2 / 12)
    folds = np.array([int(r[0][1:]) * 5 // 20 for r in data])
    assert {(r.doc_id, r.fold) for r in out} == {(r[1], int(f)) for r, f in zip(data, folds, strict=True)}
    got = {r.doc_id: r.score for r in out}
    for fold in range(5):
        beta = optimum(x[folds != fold], label[folds != fold])
        for i in np.flatnonzero(folds == fold):
            assert abs(got[data[i][1]] - 1 / (1 + np.exp(-(x[i] @ beta[:-1] + beta[-1])))) < 1e-6
    assert jobs < 90  # all models go through the rows together


def test_folds_of_one_class_and_equal_rows(spark):
    rows = [(f"q{i}", f"d{k}", int(i == 0 and k == 0), 0.5 if i else 1.5, 0.25) for i in range(5) for k in range(9)]
    out = {(r.query_id, r.doc_id): r for r in ltr.cross_validated(spark.createDataFrame(rows, SCHEMA), ["a", "b"], dimensions=7).collect()}
    assert {out["q0", f"d{k}"].score for k in range(9)} == {0.0}  # the others have no row of label 1
    for q in range(5):
        assert [out[f"q{q}", f"d{k}"].rank for k in range(9)] == list(range(1, 10))
    assert ltr.cross_validated(spark.createDataFrame([], SCHEMA), ["a", "b"]).count() == 0


def test_cosines_equal_the_library():
    turns = np.random.default_rng(1).uniform(-80, 80, (50, 40))
    assert np.abs(ltr.cosines(turns.copy()) - np.cos(2 * np.pi * (turns - np.rint(turns)))).max() < 1e-14
