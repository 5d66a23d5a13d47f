"""Cross-sectional signal research on Spark: panels in, signals, weights and reports out.

Column names used throughout: ``asset`` (series key), ``dt`` (date), ``ret`` (return, a fraction unless said otherwise).
Every operator takes DataFrames and returns a DataFrame.
"""
