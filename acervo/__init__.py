"""acervo: batch and streaming retrieval analytics over text corpora, on Spark.

Documents, queries, logs and sessions are DataFrames; every operator takes
DataFrames or Columns and returns DataFrames or Columns.
"""

__version__ = "0.1.0"
