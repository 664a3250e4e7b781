"""basketlens: customer analytics for online-retail orders on Spark.

Batch data products (order master, delivery facts, customer RFM table,
churn model) and the dashboard datasets built on them, all expressed with
the DataFrame API and ``pyspark.ml``.
"""

from basketlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
