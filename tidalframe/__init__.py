"""Tidalframe: time-series features, forecasting statistics and data preparation as Spark DataFrame operators."""
