"""partwise: additive-part (non-negative factor) analytics on Spark DataFrames.

A matrix is a long DataFrame ``(feature, sample, value)``; a model is a pair of
long weight tables.  Reshaping, alignment, measures, rankings and statistics
are declarative plans; only the iterative numeric kernels run in Arrow-backed
grouped tasks.
"""

__version__ = "0.1.0"
