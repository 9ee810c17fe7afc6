"""County-level time series and short-text analytics on PySpark."""
