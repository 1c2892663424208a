"""Training-data operators: sharding, mixing, deduplication, scoring, tokenising and search over text corpora.

Nothing else in the library imports this subpackage; it stands on PySpark, NumPy and PyArrow alone.
"""
