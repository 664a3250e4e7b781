"""The Spark fit equals a Newton solve of the reference objective, and the
AUC equals the rank-sum formula."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import churn
from basketlens.plans.marts import Marts
from basketlens.sources.adapter import logical_sources
from conftest import SF_MID


@pytest.fixture(scope="module")
def fitted(spark):
    m = Marts(logical_sources(spark, SF_MID))
    return m, m.churn


def _newton(X, y, w, c=1.0, iters=50):
    """min 0.5 |b|^2 + C sum_i w_i logloss_i, intercept unpenalised."""
    n, d = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[d, d] = 0.0
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(-A @ beta))
        grad = reg @ beta + c * A.T @ (w * (p - y))
        hess = reg + c * (A * (w * p * (1 - p))[:, None]).T @ A
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-13:
            break
    return beta


def test_coefficients_match_newton(spark, fitted):
    m, res = fitted
    cases = churn.complete_cases(m.rfm)
    z = churn.with_scaled(cases, churn.scaling_stats(cases))
    pdf = (z.select(*[f"z_{f}" for f in churn.FEATURES], "is_churned",
                    m.split.is_test().alias("is_test")).toPandas())
    tr = pdf[~pdf.is_test]
    X = tr[[f"z_{f}" for f in churn.FEATURES]].to_numpy()
    y = tr.is_churned.to_numpy().astype(float)
    n = len(y)
    w = np.where(y == 1, n / (2.0 * (y == 1).sum()), n / (2.0 * (y == 0).sum()))
    beta = _newton(X, y, w)
    got = np.array(res.coefficient_values + [res.intercept])
    assert np.allclose(got, beta, atol=1e-5), (got, beta)


def test_auc_matches_rank_sum(spark, fitted):
    m, res = fitted
    cases = churn.complete_cases(m.rfm).where(m.split.is_test())
    z = churn.with_scaled(cases, churn.scaling_stats(churn.complete_cases(m.rfm)))
    pdf = z.select("is_churned", churn.probability(res.coefficient_values, res.intercept)
                   .alias("p")).toPandas()
    pos, neg = pdf[pdf.is_churned == 1].p.to_numpy(), pdf[pdf.is_churned == 0].p.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert res.auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-9)


def test_outputs_shape(fitted):
    m, res = fitted
    coef = res.coefficients.collect()
    assert [r.Feature for r in coef] and len(coef) == 6
    assert [abs(r.Coefficient) for r in coef] == sorted(abs(r.Coefficient) for r in coef)
    assert {r.Impact for r in coef} <= {"Increases churn risk", "Reduces churn risk"}
    assert {r["class"] for r in res.report.collect()} == {"0", "1", "accuracy", "macro avg",
                                                          "weighted avg"}
    s = res.scores
    assert s.count() == m.rfm.count()
    incomplete = s.where(F.col("avg_delay_days").isNull() | F.col("avg_review_score").isNull())
    assert incomplete.where(F.col("churn_probability") != 0.5).count() == 0


def test_one_class_is_an_error(spark, fitted):
    m, _ = fitted
    with pytest.raises(ValueError, match="only one class"):
        churn.fit_churn(m.rfm.withColumn("recency_days", F.col("recency_days") + 1000))
    with pytest.raises(ValueError, match="no complete"):
        churn.fit_churn(m.rfm.withColumn("monetary", F.lit(None).cast("decimal(38,6)")))


def test_gradient_is_zero_at_the_optimum_only(fitted):
    m, res = fitted
    at = {r.parameter: r.gradient for r in
          churn.objective_gradient(m.rfm, res.coefficient_values, res.intercept).collect()}
    assert len(at) == 7 and max(map(abs, at.values())) < 1e-6
    off = churn.objective_gradient(m.rfm, [c + 0.1 for c in res.coefficient_values], res.intercept).collect()
    assert max(abs(r.gradient) for r in off) > 1e-4
