"""tagflow: Spark-native data engine for sequence labelling over annotated text.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregations and windows; Python (pandas/numpy inside
Arrow batches) is used only where a per-sequence dynamic programme is needed
(CRF likelihood and Viterbi) or for the subword segmentation of distinct words.
"""

__version__ = "0.1.0"
