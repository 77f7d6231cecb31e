"""Population-level event analytics on Spark.

Cohorts, first events, banded counts, age-standardised rates, smoothed series,
trends per area and period, and reconciliation of monthly counts. Every public
function takes DataFrames and returns a DataFrame.
"""
