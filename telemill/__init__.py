"""telemill — machine-telemetry diagnostics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst can prune, push down and codegen it.
"""

from telemill.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
