"""Customer RFM table: recency / frequency / monetary, quintile scores and
behavioural segments.

Customer grain is ``customer_unique_id``.  Quintile cut points are exact
(linear interpolation, equal values always share a bin) and computed by the
distributed :func:`exact_quantiles`; they come back as a one-row frame that
is broadcast to the customer rows, never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.lineage import table_checkpoint
from basketlens.functions.quantiles import exact_quantiles
from basketlens.functions.semantics import (first_non_null, floor_days, mode_low, money_sum,
                                            pct_true, plus_days)
from basketlens.operators.delivery import DELIVERED

# Segment rules, first match wins, default "Hibernating".
# Each rule is (label, (R lo, R hi), (F lo, F hi), (M lo, M hi)), inclusive
# score bounds on the 1..5 scales.  "Lost" can never match: the
# "Hibernating" rule before it covers every cell it covers.
SEGMENT_RULES = [
    ("Champions",           (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers",     (3, 5), (3, 5), (3, 5)),
    ("New Customers",       (4, 5), (1, 1), (1, 5)),
    ("Potential Loyalists", (3, 5), (1, 2), (1, 3)),
    ("Can't Lose Them",     (1, 2), (4, 5), (4, 5)),
    ("At Risk",             (1, 2), (3, 5), (3, 5)),
    ("Hibernating",         (1, 3), (1, 2), (1, 3)),
    ("Lost",                (1, 1), (1, 2), (1, 2)),
]
DEFAULT_SEGMENT = "Hibernating"

# Display order of the segments.
SEGMENT_ORDER = ["Champions", "Loyal Customers", "New Customers", "Potential Loyalists",
                 "At Risk", "Can't Lose Them", "Hibernating", "Lost"]

# Frequency bins (right-closed upper edges of scores 1..4;
# anything above the last edge scores 5).
FREQUENCY_EDGES = [1, 2, 3, 5]

QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
# Recency (whole days) and monetary (6-decimal money) both fit exactly.
_EDGE = "decimal(28,6)"


def delivered_orders(master: DataFrame) -> DataFrame:
    return master.where(F.col("order_status") == DELIVERED)


def snapshot_date(master: DataFrame) -> DataFrame:
    """One row: latest delivered purchase plus one day."""
    return delivered_orders(master).agg(
        plus_days(F.max("order_purchase_timestamp"), 1).alias("snapshot_date"))


def rfm_base(master: DataFrame) -> DataFrame:
    """Per customer: last order, order count, money, review and delivery
    averages, first state and most used payment type, and recency in days.

    One shuffle on the customer key; every aggregate is partial-capable, so
    a customer with a huge number of orders is reduced map-side.
    """
    base = delivered_orders(master)
    per_customer = (base.where(F.col("customer_unique_id").isNotNull())
                    .groupBy("customer_unique_id")
                    .agg(F.max("order_purchase_timestamp").alias("last_order_date"),
                         F.count("order_id").alias("frequency"),
                         money_sum("payment_value").alias("monetary"),
                         F.avg("review_score").alias("avg_review_score"),
                         pct_true("is_late").alias("late_pct"),
                         F.avg("delay_days").alias("avg_delay_days"),
                         first_non_null("customer_state", "order_purchase_timestamp", "order_id")
                         .alias("customer_state"),
                         F.coalesce(mode_low("payment_type"), F.lit("unknown")).alias("payment_type")))
    snap = one_row(snapshot_date(master))
    return (per_customer.crossJoin(snap)
            .withColumn("recency_days", floor_days("last_order_date", "snapshot_date"))
            .drop("snapshot_date"))


def rfm_cutpoints(base: DataFrame, accuracy: int = 10_000,
                  approximate: bool = False) -> DataFrame:
    """One row: the six quintile edges of recency (``r0``..``r5``) and of
    monetary (``m0``..``m5``), plus the highest frequency.

    Both metrics go through one set of quantile passes: they are stacked as
    (metric, value) rows and grouped by metric (two groups, a proven bound).
    ``approximate=True`` opts in to one ``percentile_approx`` pass instead
    (rank error at most n / accuracy; edges are then sample values, not
    interpolated ones).
    """
    stacked = base.select(F.explode(F.array(
        F.struct(F.lit("r").alias("metric"), F.col("recency_days").cast(_EDGE).alias("v")),
        F.struct(F.lit("m").alias("metric"), F.col("monetary").cast(_EDGE).alias("v")),
    )).alias("s")).select("s.metric", "s.v")
    names = [f"q{i}" for i in range(6)]
    if approximate:
        q = stacked.groupBy("metric").agg(
            F.percentile_approx("v", QUINTILES, accuracy).alias("_q"))
        q = q.select("metric", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        q = exact_quantiles(stacked, "v", QUINTILES, names, by=["metric"], accuracy=accuracy,
                            max_groups=2)
    edges = q.agg(*[F.max(F.when(F.col("metric") == p, F.col(n))).alias(f"{p}{i}")
                    for p in ("r", "m") for i, n in enumerate(names)])
    fmax = base.agg(F.max("frequency").alias("max_frequency"))
    return edges.crossJoin(fmax)


def _strictly_increasing(prefix: str) -> Column:
    cond = F.lit(True)
    for i in range(5):
        cond = cond & (F.col(f"{prefix}{i}") < F.col(f"{prefix}{i + 1}"))
    return cond


def _quintile(x: str, prefix: str, labels: list[int]) -> Column:
    """Right-closed bins on the edges, lowest value included; fails like a
    quantile cut does when two edges coincide."""
    expr = None
    for i, label in enumerate(labels[:-1]):
        cond = F.col(x) <= F.col(f"{prefix}{i + 1}")
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    expr = expr.otherwise(labels[-1])
    return (F.when(~_strictly_increasing(prefix),
                   F.raise_error(F.lit(f"quintile edges of {x} are not unique")))
            .otherwise(expr).cast("int"))


def frequency_score(c: str = "frequency") -> Column:
    expr = None
    for score, edge in enumerate(FREQUENCY_EDGES, start=1):
        cond = F.col(c) <= edge
        expr = F.when(cond, score) if expr is None else expr.when(cond, score)
    return expr.otherwise(len(FREQUENCY_EDGES) + 1).cast("int")


def segment_of(r: str = "R", f: str = "F", m: str = "M") -> Column:
    expr = None
    for label, (rl, rh), (fl, fh), (ml, mh) in SEGMENT_RULES:
        cond = (F.col(r).between(rl, rh) & F.col(f).between(fl, fh) & F.col(m).between(ml, mh))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(DEFAULT_SEGMENT)


def score(base: DataFrame, cuts: DataFrame) -> DataFrame:
    """R (recency quintile, 5 = most recent), F (fixed frequency bins),
    M (monetary quintile), the RFM code and total, and the segment."""
    scored = (base.crossJoin(one_row(cuts))
              .withColumn("R", _quintile("recency_days", "r", [5, 4, 3, 2, 1]))
              .withColumn("F", frequency_score())
              .withColumn("M", _quintile("monetary", "m", [1, 2, 3, 4, 5])))
    return (scored.select(*base.columns, "R", "F", "M")
            .withColumn("RFM_score", F.concat(F.col("R").cast("string"), F.col("F").cast("string"),
                                              F.col("M").cast("string")))
            .withColumn("RFM_total", F.col("R") + F.col("F") + F.col("M"))
            .withColumn("Segment", segment_of()))


def build_rfm(master: DataFrame, keep=None, **quantile_opts) -> DataFrame:
    """The scored customer table.

    The customer-grain base feeds the quantile passes and the scoring pass,
    so it is materialised once by ``keep`` (default: a table in the checkpoint
    folder)."""
    keep = keep or (lambda df: table_checkpoint(df, "rfm_base"))
    base = keep(rfm_base(master))
    return score(base, rfm_cutpoints(base, **quantile_opts))


def segment_rank(c: str = "Segment") -> Column:
    """Position of a segment in the display order (unknown labels last)."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SEGMENT_ORDER]), F.col(c))
    return F.when(pos == 0, F.lit(len(SEGMENT_ORDER) + 1)).otherwise(pos)
