"""Quillspark: a PySpark-native engine for scholarly-record analytics.

The core (``functions``, ``operators``, ``sources``, ``streaming``, ``plans``) never imports the
optional ``llm`` subpackage, which holds the operators used to prepare training data.
"""

__version__ = "0.1.0"
