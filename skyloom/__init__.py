"""Spark-first analytics for self-describing, record-oriented science data.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (ready-made queries
with their SQL), ``streaming``.
"""

__version__ = "0.1.0"
