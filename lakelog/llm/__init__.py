"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames, reads only the columns it names, and returns a lazy DataFrame;
intermediate tables that are read more than once are checkpointed to the
folder in ``spark.checkpoint.dir``.
"""
