"""rollspark: rollout and label analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from native
column expressions, aggregates, joins and windows. Nothing is collected to the
driver; group statistics are computed with partial aggregation and joined back
so a hot group is handled by AQE skew-join splitting instead of one task.
"""

from rollspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
