"""dayline: date-partitioned, time-aligned archives as Spark DataFrames."""
