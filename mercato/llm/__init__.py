"""Operators for preparing language-model training data on Spark.

Every operator takes DataFrames and returns DataFrames; nothing outside this
subpackage imports it.  ``queries`` holds the registered queries.
"""
