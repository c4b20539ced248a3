"""Training-data operators: deduplication, extraction, tokenizing, classifying.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin ``opN_<name>`` queries over the tables.
"""
