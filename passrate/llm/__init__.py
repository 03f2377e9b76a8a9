"""Operators for preparing language-model training text.

Every operator takes and returns Spark DataFrames, treats a null text as an
empty one, and keeps no state outside the job and the cluster's shared
checkpoint folder.  Nothing outside this subpackage imports it.
"""
