"""Retail demand jobs on Spark: cleaning, features, forecasts, backtests and drift monitoring."""
