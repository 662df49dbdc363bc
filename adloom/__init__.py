"""adloom: labour-market text, basket and data-quality analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` that only declares a
logical plan; nothing in the package collects rows to the driver.
"""

__version__ = "0.1.0"
