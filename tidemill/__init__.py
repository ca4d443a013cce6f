"""Time-series analytics over Spark DataFrames: panels, resampling, hierarchies, diagnostics, forecasts, reconciliation."""
