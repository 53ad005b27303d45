"""marquee: Spark-native recommendation analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql`` expressions; Catalyst plans the work.
"""

__version__ = "0.1.0"
