"""leafmill: a Spark-first engine for checking, splitting, searching and reviewing
long guideline documents.

Everything is a function from DataFrames (plus a small config) to DataFrames; nothing
here holds global state and nothing collects data that grows with the input.
"""

__version__ = "0.1.0"
