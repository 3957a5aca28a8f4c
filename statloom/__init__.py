"""statloom: whole-table statistical profiling and analysis on Spark.

Every analysis is a function ``DataFrame -> DataFrame`` that returns a tidy,
long result (one row per column, pair, group, lag or component) and runs on the
full table: aggregations are partial (map-side) hash aggregates, ranks and
quantiles use a range-partitioned global rank instead of a single-task window,
and only schema-sized metadata (column names, counts) ever reaches the driver.
"""

from statloom.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
