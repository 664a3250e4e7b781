"""Churn model: a weighted, L2-regularised logistic regression on the RFM
features, fitted with ``pyspark.ml`` (distributed L-BFGS).

Matching the reference objective:

* features are standardised with the *population* standard deviation, fitted
  on all complete rows before the split (a zero deviation leaves the centred
  value, i.e. 0);
* balanced class weights ``n / (2 n_k)`` on the training rows;
* the objective ``0.5 |w|^2 + C sum_i s_i loss_i`` with C = 1 equals Spark's
  ``(1 / sum s_i) sum_i s_i loss_i + regParam / 2 |w|^2`` with
  ``regParam = 1 / sum s_i``; with balanced weights ``sum s_i`` is the number
  of training rows.  ``standardization=False`` because the inputs are
  already scaled and the penalty applies to the scaled coefficients.

The 80/20 split is exactly stratified by the label: the customers with the
smallest digests of each class are the test rows (``functions.stratified``;
deterministic and independent of partitioning).

Scoring uses the fitted coefficients as a column expression (sigmoid of a
dot product), so scoring every customer is one narrow, codegen'd pass;
customers with an incomplete feature row get 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.stratified import Split, stratified_split
from basketlens.sources.schemas import FEATURES

CHURN_DAYS = 180
HIGH_RISK = 0.7
UNSCORED = 0.5
TEST_SHARE = (1, 5)
ID = "customer_unique_id"
LABEL = "is_churned"


def with_churn_label(rfm: DataFrame) -> DataFrame:
    return rfm.withColumn(LABEL, (F.col("recency_days") > CHURN_DAYS).cast("int"))


def churn_base_rate(rfm: DataFrame) -> DataFrame:
    return with_churn_label(rfm).agg((F.avg(F.col(LABEL).cast("double")) * 100.0).alias("churn_rate"))


def complete_cases(rfm: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    cond = F.col(LABEL).isNotNull()
    for f in features:
        cond = cond & F.col(f).isNotNull()
    return rfm.where(cond)


def is_complete(features: list[str] = FEATURES) -> Column:
    cond = F.col(LABEL).isNotNull()
    for f in features:
        cond = cond & F.col(f).isNotNull()
    return cond


def scaling_stats(cases: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: mean and population standard deviation per feature."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"mean_{f}"), F.stddev_pop(x).alias(f"std_{f}")]
    return cases.agg(*aggs)


def scaled_feature(f: str) -> Column:
    centred = F.col(f).cast("double") - F.col(f"mean_{f}")
    std = F.col(f"std_{f}")
    return F.when(std == 0, centred).otherwise(centred / std)


def with_scaled(df: DataFrame, stats: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Adds ``z_<feature>`` columns (the stats row is broadcast)."""
    out = df.crossJoin(one_row(stats))
    return out.select(*df.columns, *[scaled_feature(f).alias(f"z_{f}") for f in features])


def split_of(cases: DataFrame) -> Split:
    """The train/test split of the complete rows."""
    return stratified_split(cases, LABEL, ID, TEST_SHARE)


def class_weights(train: DataFrame) -> DataFrame:
    """(label, rows, weight) with weight = n / (2 n_k)."""
    counts = train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))
    total = train.agg(F.count(F.lit(1)).alias("n"))
    return (counts.crossJoin(one_row(total))
            .select(F.col(LABEL), F.col("rows"),
                    (F.col("n") / (F.lit(2.0) * F.col("rows"))).alias("weight")))


def probability(coefficients: list[float], intercept: float,
                features: list[str] = FEATURES) -> Column:
    """Sigmoid of intercept + coefficients . scaled features."""
    margin = F.lit(float(intercept))
    for w, f in zip(coefficients, features):
        margin = margin + F.lit(float(w)) * F.col(f"z_{f}")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score_customers(rfm: DataFrame, stats: DataFrame, coefficients: list[float],
                    intercept: float, features: list[str] = FEATURES) -> DataFrame:
    """The customer table with ``churn_probability``: the model probability
    for complete rows, 0.5 otherwise.  One narrow pass, no join back."""
    labelled = rfm if LABEL in rfm.columns else with_churn_label(rfm)
    z = with_scaled(labelled, stats, features)
    p = F.when(is_complete(features), probability(coefficients, intercept, features)).otherwise(
        F.lit(UNSCORED))
    return z.select(*labelled.columns, p.alias("churn_probability"))


def feature_label(f: str) -> str:
    """Display name of a feature: underscores to spaces, title case."""
    return f.replace("_", " ").title()


@dataclass
class ChurnResult:
    scores: DataFrame          # customer table + is_churned + churn_probability
    coefficients: DataFrame    # Feature, Coefficient, Impact (by |Coefficient|)
    metrics: DataFrame         # one row: auc, rows, churn rate, iterations
    report: DataFrame          # classification report rows
    coefficient_values: list[float]
    intercept: float
    auc: float


def fit_churn(rfm: DataFrame, features: list[str] = FEATURES, max_iter: int = 1000,
              tol: float = 1e-10) -> ChurnResult:
    """Raises ``ValueError`` when the training rows hold only one class."""
    spark = rfm.sparkSession
    labelled = with_churn_label(rfm)
    cases = complete_cases(labelled, features)
    # One pass for the scaling row; everything after it uses the values.
    lazy = scaling_stats(cases, features)
    stats = spark.createDataFrame([lazy.first()], lazy.schema)
    assembled = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="features",
                                handleInvalid="error").transform(with_scaled(cases, stats, features))
    # The optimiser makes many passes over the training rows; the test rows
    # are scored from the same frame.
    data = assembled.select("features", *[f"z_{f}" for f in features], LABEL, split_of(cases).is_test().alias("is_test"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = data.where(~F.col("is_test")), data.where("is_test")
        counts = {r[LABEL]: r["rows"] for r in  # at most one row per class
                  train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows")).collect()}
        if len(counts) < 2:
            raise ValueError("churn model: the training rows hold "
                             f"{'only one class' if counts else 'no complete customer'}")
        n_train = sum(counts.values())
        weight = F.coalesce(*[F.when(F.col(LABEL) == k, F.lit(n_train / (2.0 * n))) for k, n in counts.items()])
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                regParam=1.0 / n_train, elasticNetParam=0.0,
                                standardization=False, fitIntercept=True, maxIter=max_iter,
                                tol=tol, family="binomial")
        model = lr.fit(train.select("features", F.col(LABEL).cast("double").alias("label"),
                                    weight.alias("weight")))
        coef = [float(c) for c in model.coefficients.toArray()]
        intercept = float(model.intercept)
        scored = test.select(F.col(LABEL).cast("double").alias("label"),
                             probability(coef, intercept, features).alias("p"))
        auc = area_under_roc(scored)
        lazy = classification_report(predictions(scored))
        rows = lazy.collect()  # five rows
        n_test = next(r["support"] for r in rows if r["class"] == "accuracy")
        report = spark.createDataFrame(rows, lazy.schema)
    finally:
        data.unpersist()

    metrics = spark.createDataFrame(
        [(auc, n_train, n_test, intercept, model.summary.totalIterations)],
        "auc double, train_rows long, test_rows long, intercept double, iterations int")
    return ChurnResult(score_customers(labelled, stats, coef, intercept, features),
                       coefficient_table(spark, features, coef), metrics, report, coef, intercept, auc)


def objective_gradient(labelled: DataFrame, coefficients: list[float], intercept: float,
                       features: list[str] = FEATURES) -> DataFrame:
    """``(parameter, gradient)`` of the stated objective on the training rows,
    per row: zero for every parameter exactly at the optimum."""
    cases = complete_cases(labelled, features)
    z = with_scaled(cases, scaling_stats(cases, features), features).where(~split_of(cases).is_test())
    z = z.join(F.broadcast(class_weights(z).select(LABEL, "weight")), LABEL)  # two rows
    error = F.col("weight") * (probability(coefficients, intercept, features) - F.col(LABEL))
    sums = z.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("g_intercept"),
                 *[F.avg(error * F.col(f"z_{f}")).alias(f"g_{f}") for f in features])
    rows = [F.struct(F.lit("intercept").alias("parameter"), F.col("g_intercept").alias("gradient"))]
    rows += [F.struct(F.lit(f).alias("parameter"),
                      (F.col(f"g_{f}") + F.lit(w) / F.col("n")).alias("gradient"))
             for f, w in zip(features, coefficients)]
    return sums.select(F.inline(F.array(*rows)))


def centroid_coefficients(labelled: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: per feature the scaled mean of the churned customers minus that
    of the others, a model that needs no optimiser."""
    cases = complete_cases(labelled, features)
    z = with_scaled(cases, scaling_stats(cases, features), features)
    return z.agg(*[(F.avg(F.when(F.col(LABEL) == 1, F.col(f"z_{f}")))
                    - F.avg(F.when(F.col(LABEL) == 0, F.col(f"z_{f}")))).alias(f) for f in features])


def test_scores(labelled: DataFrame, stats: DataFrame, coefficients: list[float],
                intercept: float, features: list[str] = FEATURES) -> DataFrame:
    """(label, p) for the complete rows of the test split."""
    cases = complete_cases(labelled, features)
    return with_scaled(cases.where(split_of(cases).is_test()), stats, features).select(
        F.col(LABEL).cast("double").alias("label"),
        probability(coefficients, intercept, features).alias("p"))


def area_under_roc(scored: DataFrame) -> float:
    """Exact ROC-AUC of (label, p): no down-sampling of the curve, so ties
    count one half, as in the rank-sum formula; the curve is built by a
    distributed sort."""
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label",
                                         metricName="areaUnderROC", numBins=0).evaluate(scored)


def predictions(scored: DataFrame) -> DataFrame:
    """(label, prediction) with the decision threshold at probability 0.5."""
    return scored.select("label", (F.col("p") > 0.5).cast("double").alias("prediction"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and
    support-weighted averages; a zero denominator gives 0.

    Counts come from one conditional aggregate; the arithmetic runs on the
    resulting single row.
    """
    lab, prd = F.col("label"), F.col("prediction")
    c = pred.agg(*[F.count_if((lab == a) & (prd == b)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    per = {}
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        predicted = F.col(f"c0{k}") + F.col(f"c1{k}")
        actual = F.col(f"c{k}0") + F.col(f"c{k}1")
        p, r = div(tp, predicted), div(tp, actual)
        per[k] = (p, r, div(F.lit(2.0) * p * r, p + r), actual)
    acc = div(F.col("c00") + F.col("c11"), n)

    def row(name, p, r, f1, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f1.alias("f1_score"), s.cast("long").alias("support"))

    macro = [(per[0][i] + per[1][i]) / 2.0 for i in range(3)]
    weighted = [div(per[0][i] * per[0][3] + per[1][i] * per[1][3], n) for i in range(3)]
    rows = F.array(
        row("0", *per[0]), row("1", *per[1]),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", *macro, n), row("weighted avg", *weighted, n),
    )
    return c.select(F.inline(rows))


def coefficient_table(spark, features: list[str], coefficients: list[float]) -> DataFrame:
    rows = [(feature_label(f), float(c), "Increases churn risk" if c > 0 else "Reduces churn risk")
            for f, c in zip(features, coefficients)]
    return (spark.createDataFrame(rows, "Feature string, Coefficient double, Impact string")
            .orderBy(F.abs("Coefficient")))

