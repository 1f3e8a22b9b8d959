"""Market time series and trade research on Spark DataFrames."""
