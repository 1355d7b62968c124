"""Column functions. Everything here stays in Spark's built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
