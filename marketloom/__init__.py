"""Market time series and policy documents on Spark: operators over DataFrames."""
