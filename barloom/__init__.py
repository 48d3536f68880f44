"""Panel analytics on Spark: time-series, cross-sectional and evidence operators over long tables."""

__version__ = "0.1.0"
