"""prepmill: table preparation and supervised modelling as Spark DataFrame functions.

Every operator takes a DataFrame (or several) and returns a DataFrame or a
``pyspark.ml`` model.  Work on rows stays on executors; the driver only sees
schemas, one-row fits, bounded lookup tables and metric rows.
"""

__version__ = "0.1.0"
