"""tessera: Spark-native analytics for pooled imaging screens.

Every operator takes and returns DataFrames, so Catalyst sees one declarative
plan from the tile or read scan to the gene statistics.
"""

__version__ = "0.1.0"
