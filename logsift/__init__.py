"""logsift: cloud audit-log analytics (CloudTrail, VPC Flow Logs, S3 access logs) on Spark.

Sources parse raw log directories into typed DataFrames; operators are pure
DataFrame -> DataFrame analyses; plans bundle them and write the results.
"""

__version__ = "0.1.0"
