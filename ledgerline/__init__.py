"""ledgerline: Spark-native analytics for a startup knowledge base, chat datasets
and model-output / training-run data.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions``; nothing runs on the driver except tiny rule tables.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
