"""readlens: reading-behaviour analytics as plain Spark DataFrame functions.

Every operator takes DataFrames (plus column names and thresholds as
parameters) and returns a lazily-planned DataFrame built from built-in Spark
expressions only.  Nothing in the library creates a session, collects data or
runs Python per row; the caller decides when to execute or write.
"""

__version__ = "0.1.0"
