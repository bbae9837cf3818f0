"""Velkora: a Spark-native engine for rules over traces, corpora and fact tables.

Every operator is a function from DataFrame(s) to DataFrame.  The subpackage ``llm``
(training-data preparation) is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
