"""lodestar: dataset preparation and evaluation analytics as lazy Spark DataFrames."""
