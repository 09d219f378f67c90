"""Multivariate statistics: heavy sums run on Spark, small matrices on the driver."""
