"""Exact distributed quantiles against NumPy's linear quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.functions import quantiles
from basketlens.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of all rows share one value; the rest is heavily tied.
    df = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(42.0))
         .otherwise(F.floor(F.rand(11) * 5000) / 7).alias("v"),
        (F.col("id") % 3 + F.col("id") % 2).alias("g")).cache()
    return df, df.toPandas()


@pytest.mark.parametrize("accuracy", [50, 500, 10_000])
def test_global_matches_numpy(skewed, accuracy):
    # 60,000 rows: the brackets come from the sketch up to accuracy 5,999
    df, pdf = skewed
    got = exact_quantiles(df, "v", PROBS, NAMES, accuracy=accuracy).first()
    assert np.allclose([float(got[n]) for n in NAMES], np.quantile(pdf.v.values, PROBS),
                       rtol=0, atol=1e-9)


@pytest.mark.parametrize("accuracy", [50, 500, 10_000])
@pytest.mark.parametrize("max_groups", [None, 4])
def test_grouped_matches_numpy(skewed, accuracy, max_groups):
    df, pdf = skewed
    rows = exact_quantiles(df, "v", PROBS, NAMES, by=["g"], accuracy=accuracy,
                           max_groups=max_groups).collect()
    assert len(rows) == pdf.g.nunique() == 4
    for r in rows:
        want = np.quantile(pdf[pdf.g == r.g].v.values, PROBS)
        assert np.allclose([float(r[n]) for n in NAMES], want, rtol=0, atol=1e-9)


@pytest.mark.parametrize("accuracy,bound", [(20, 50), (100, 200), (10_000, 1000)])
def test_last_window_is_bounded(skewed, monkeypatch, accuracy, bound):
    """However coarse the sketch, brackets are narrowed until they hold at
    most ``bound`` rows between their ends; results stay exact."""
    df, pdf = skewed
    seen, running = [], quantiles._running

    def watched(counted, by):
        seen.extend(r["n"] for r in counted.groupBy(*by, "_j").agg(F.count("_x").alias("n")).collect())
        return running(counted, by)

    monkeypatch.setattr(quantiles, "_running", watched)
    wide = df.withColumn("v", F.col("v") + F.when(F.col("v") != 42, F.rand(3) / 1000).otherwise(0)).persist()
    values = wide.select("g", "v").toPandas()
    got = exact_quantiles(wide, "v", PROBS, NAMES, accuracy=accuracy, bound=bound).first()
    assert np.allclose([float(got[n]) for n in NAMES], np.quantile(values.v, PROBS), rtol=0, atol=1e-9)
    for r in exact_quantiles(wide, "v", PROBS, NAMES, by=["g"], accuracy=accuracy, bound=bound, max_groups=4).collect():
        assert np.allclose([float(r[n]) for n in NAMES], np.quantile(values.v[values.g == r.g], PROBS), rtol=0, atol=1e-9)
    assert len(seen) == 6 + 4 * 6 and max(seen) <= bound + 2
    wide.unpersist()


def test_more_groups_than_promised_fail(skewed):
    df, _ = skewed
    with pytest.raises(Exception, match="more groups"):
        exact_quantiles(df, "v", [0.5], ["m"], by=["g"], max_groups=3).collect()


def test_values_beyond_double_precision(spark):
    """A third of the rows share a decimal that no double holds; neighbours
    differ from it in the last place."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("900719925474.9301").cast("decimal(28,4)"))
         .otherwise((F.lit("900719925474.9000").cast("decimal(28,4)")
                     + (F.col("id") % 700).cast("decimal(28,4)") / 10000).cast("decimal(28,4)")).alias("v"))
    values = sorted(int(r.v * 10000) for r in df.collect())
    for accuracy in (100, 1000, 10_000):
        got = exact_quantiles(df, "v", [0.2, 0.5, 0.8], ["a", "b", "c"], accuracy=accuracy).first()
        for name, tenths in (("a", 2), ("b", 5), ("c", 8)):
            h, rest = divmod((len(values) - 1) * tenths, 10)
            want = (values[h] * (10 - rest) + values[h + 1] * rest) / 10
            assert abs(float(got[name]) * 10000 - want) < 1  # shown through a double
            assert (got[name] * 100000).to_integral_value() == values[h] * (10 - rest) + values[h + 1] * rest
    longs = spark.range(20000).select((F.lit(2 ** 60) + F.col("id")).alias("v"))
    assert int(exact_quantiles(longs, "v", [0.25], ["q"], accuracy=100).first().q * 4) == 2 ** 62 + 19999


def test_probabilities_have_to_be_fractions(spark):
    df = spark.range(3).select(F.col("id").alias("v"))
    for p in (0.1234567891, -0.1, 1.5):
        with pytest.raises(ValueError, match="probability"):
            exact_quantiles(df, "v", [p], ["q"])


def test_integer_and_decimal_interpolation_is_exact(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 10]], "v long")
    q = exact_quantiles(df, "v", [0.3, 0.5], ["a", "b"]).first()
    assert float(q.a) == pytest.approx(2.2) and float(q.b) == 3.0
    dec = df.select(F.col("v").cast("decimal(18,4)").alias("v"))
    qd = exact_quantiles(dec, "v", [0.3], ["a"]).first()
    assert str(qd.a).startswith("2.2")


def test_nulls_ignored(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    q = exact_quantiles(df, "v", [0.5], ["m"]).first()
    assert q.m == 2.0


def test_approximate_cutpoints_opt_in(spark):
    from basketlens.operators.rfm import rfm_base, rfm_cutpoints, score
    from basketlens.plans.marts import Marts
    from basketlens.sources.adapter import logical_sources
    from conftest import SF_MID
    base = rfm_base(Marts(logical_sources(spark, SF_MID), keep="none").master).cache()
    exact = rfm_cutpoints(base).first()
    approx = rfm_cutpoints(base, approximate=True, accuracy=100).first()
    pdf = base.select("recency_days").toPandas().recency_days
    n = len(pdf)
    for i in range(1, 5):
        # the approximate edge is a sample value whose rank is within n / accuracy
        rank = (pdf < float(approx[f"r{i}"])).sum()
        assert abs(rank - 0.2 * i * n) <= n / 100 + 1
        assert abs(float(approx[f"r{i}"]) - float(exact[f"r{i}"])) <= pdf.max() - pdf.min()
    assert score(base, rfm_cutpoints(base, approximate=True)).count() == n
