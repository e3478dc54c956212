"""Site time series at scale: clean, fill, combine, aggregate, score and calibrate, on Spark DataFrames."""

SITE = "sitename"
DATE = "date"

__all__ = ["DATE", "SITE"]
