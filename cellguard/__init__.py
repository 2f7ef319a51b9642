"""cellguard: privacy-preserving cohort exploration on Spark DataFrames."""

__version__ = "0.1.0"
