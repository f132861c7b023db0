"""Training-data operators over ``documents`` and ``pages`` (one module each).

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries and their SQL.
"""
