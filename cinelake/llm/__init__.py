"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing outside this subpackage imports it. ``registry`` holds the thin
``opN_<name>`` queries and their SQL; each operator lives in its own module.
"""
