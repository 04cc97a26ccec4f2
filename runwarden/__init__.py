"""runwarden: runtime-behaviour analytics for container workloads on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here runs
a job by itself except where a docstring says so.
"""

from runwarden.session import build_session, configure

__all__ = ["build_session", "configure"]
