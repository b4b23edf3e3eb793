"""panelkit: panel enrichment and regression analytics as Spark DataFrame operators.

Sub-packages:
  functions  Column -> Column scalar rules (cleaning, dates, geodesy, fuzzy ratio)
  sources    scans and sinks (typed CSV, file-name keys, batch union, reject split)
  operators  DataFrame -> DataFrame operators (joins, imputation, lookback, features, models, contrast)
  plans      the query catalogue over the driver tables, and its DuckDB oracle SQL
  streaming  the stateless operators wired to Structured Streaming sources
"""

__version__ = "0.1.0"
