"""tidegate: change-data quality on Spark.

Decode change envelopes, compare rows with table contracts, detect and classify
schema drift, route, repair with checks and an audit trail, and deliver ordered
change logs and current-state tables.  Every operator maps DataFrames to
DataFrames and runs unchanged in batch and inside ``foreachBatch``.
"""

from tidegate.session import configure

__all__ = ["configure"]
