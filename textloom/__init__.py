"""textloom: text analytics on PySpark DataFrames.

Every operator takes and returns DataFrames or Columns; nothing here collects
data that grows with the corpus.
"""

__version__ = "0.1.0"
