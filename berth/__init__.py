"""berth: set-at-a-time certificate-folder analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver. See README.md for the operator map.
"""

from berth.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
