"""Temporal memory retrieval as PySpark DataFrame plans.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame stages), ``plans`` (query language, analysis, search), ``sources``
(tables and the store), ``streaming`` (ingest).
"""

__version__ = "0.1.0"
