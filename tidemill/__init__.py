"""Declarative loading of analytical tables on Spark.

``LoadSpec`` says what to load; ``Loader`` plans windows, extracts, applies a
strategy and publishes the result to a ``TableStore``, with runs, locks and
logs in a ``Registry``.  The strategies in ``operators`` are functions from
DataFrames to a DataFrame and can be used alone.
"""
